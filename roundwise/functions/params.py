"""Parameters of the domain. These are fixed values: results depend on them."""

#: Target multipliers and the window spans of locked forecasts.
SPANS = {5: 3, 10: 6, 20: 10, 50: 17, 100: 25, 500: 50, 1000: 60}
#: The same targets with the spans of the edge engine.
EDGE_SPANS = {5: 8, 10: 13, 20: 15, 50: 22, 100: 32, 500: 55, 1000: 80}
#: Targets and windows of the empirical ("oracle") forecasts.
ORACLE_WINDOWS = {5: 4, 10: 6, 15: 7, 30: 13, 50: 20, 100: 30, 200: 50, 500: 75, 1000: 100}
#: Thresholds whose droughts are reported.
DROUGHTS = (2, 5, 10, 20, 25, 30, 50, 100, 200, 500, 1000)
#: Cut points of the nine tokens 0 to 8.
TOKENS = (1.2, 1.5, 2, 3, 5, 10, 20, 50)
#: Closed buckets with their holes: name, low, high.
BUCKETS = (("micro", 1.0, 1.99), ("low", 2.0, 4.99), ("mid", 5.0, 9.99), ("high", 10.0, 24.99), ("moon", 25.0, float("inf")))
