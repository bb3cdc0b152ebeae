import threading

from roundwise.streaming.latest import Latest


def test_callers_share_one_result_a_round(spark):
    latest, made = Latest(), []

    def make(n):
        made.append(n)
        return spark.range(n)

    assert latest.stale("x") is None
    got = []
    threads = [threading.Thread(target=lambda: got.append(latest.get("x", 5, lambda: make(5)).count())) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == [5] * 6 and made == [5]
    assert latest.get("x", 7, lambda: make(7)).count() == 7 and latest.get("x", 6, lambda: make(6)).count() == 7
    assert latest.get("y", 1, lambda: make(1)).count() == 1 and made == [5, 7, 1] and latest.stale("x").count() == 7
    latest.clear()
    assert latest.stale("x") is None
