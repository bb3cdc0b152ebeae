"""Heterogeneous JSON feeds, brought to one schema by column expressions.

Keys are probed in a fixed order; a key that is absent or null passes to the next
one. now, where a feed has no time, is an argument, so results don't change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where feeds keep rounds, and the names of a round's fields, in order.
CONTAINERS = ("payload", "rounds", "history", "items", "data", "entries", "list", "result", "response", "data.rounds", "data.history", "data.entries", "data.list", "data.items", "data.result", "data.response", "result.history", "result.entries", "result.list")
ID_KEYS = ("roundId", "round_id", "id", "gameId", "gameRoundId", "round", "sequence", "block", "index", "number", "game_number")
VALUE_KEYS = ("multiplier", "bustMultiplier", "crashMultiplier", "bust", "gameResult", "crashPoint", "crash_point", "result", "payout", "cashout", "value", "score", "finalMultiplier")
TIME_KEYS = ("createdAt", "created_at", "time", "date")
#: Letters of the codes of a sequence entry: as ingested, and as read.
INGEST_LETTERS = {"3": "C", "5": "B", "6": "A"}
READ_LETTERS = {"3": "A", "5": "B", "6": "C"}


def number(text: Column) -> Column:
    """First signed decimal of a text without commas and a trailing x; a text that is
    a JSON number with an exponent (how 10 million is written) is taken whole."""
    plain = F.regexp_replace(F.regexp_replace(text, "(?i)x$", ""), ",", "")
    found = F.regexp_extract(plain, r"-?\d+(?:\.\d+)?", 0)
    return F.when(text.rlike(r"^-?\d+(?:\.\d+)?[eE][+-]?\d+$"), text).otherwise(found).try_cast("double")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fields_of(text: Column) -> Column:
    """The fields of a JSON object as texts, by one parse; null of anything else."""
    return F.from_json(text, "map<string,string>")


def rows_of(payload: Column) -> Column:
    """Array of the JSON rows of a payload: itself, or the first container that
    is an array. The payload is parsed once, and its inner containers once each."""
    rows = lambda x: F.when(F.ltrim(x).startswith("["), x)
    inner = list(dict.fromkeys(c.split(".")[0] for c in CONTAINERS if "." in c))

    def pick(outer: Column) -> Column:
        parsed = F.create_map(*[x for k in inner for x in (F.lit(k), fields_of(F.try_element_at(outer, F.lit(k))))])

        def among(m: Column) -> Column:
            at = lambda c: F.try_element_at(F.try_element_at(m, F.lit(c.split(".")[0])), F.lit(c.split(".")[1])) if "." in c else F.try_element_at(outer, F.lit(c))
            return F.coalesce(*[rows(at(c)) for c in CONTAINERS])

        return let(parsed, among)

    return F.from_json(F.coalesce(rows(payload), let(fields_of(payload), pick)), "array<string>")


def first_key(fields: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_element_at(fields, F.lit(k)) for k in keys])


def tower_letters(raw: Column, letters: dict[str, str]) -> Column:
    """Letters of a sequence in JSON; unknown codes are left out."""
    entries = F.from_json(raw, "array<struct<level:int,result:string,choice:string,value:string>>")
    code = F.transform(entries, lambda e: F.trim(F.coalesce(e["result"], e["choice"], e["value"])))
    known = F.create_map(*[F.lit(x) for kv in letters.items() for x in kv])
    return F.array_join(F.filter(F.transform(code, lambda c: F.try_element_at(known, c)), lambda x: x.isNotNull()), "")


def java_hash(text: Column) -> Column:
    """The 31-multiplier 32-bit string hash, of ASCII text."""
    wrap = lambda x: F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.aggregate(F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))


def synthetic_id(seed: Column, multiplier: Column, ts: Column) -> Column:
    """Time, multiplier and hash run together and cut to 15 digits."""
    mult = F.floor(multiplier * 1000 + 0.5).cast("string")
    text = F.concat(ts.cast("long").cast("string"), F.when(F.length(mult) < 4, F.lpad(mult, 4, "0")).otherwise(mult), F.lpad(F.abs(java_hash(seed) % 1000).cast("string"), 3, "0"))
    return F.substring(text, 1, 15).cast("long")


def normalized(rows: DataFrame, row: str, now: int) -> DataFrame:
    """rows and round_id, multiplier, timestamp of each JSON row (object or
    tuple); rows without a usable multiplier or id are dropped. Each row is parsed
    once; a generator keeps the optimizer from doing it again for the filter."""
    r = F.col(row)

    def seen(x: Column) -> Column:
        """The texts that count, of an object's fields or a tuple's parts."""
        m, p = x["fields"], x["parts"]
        length = F.length(tower_letters(F.try_element_at(m, F.lit("gameResult")), INGEST_LETTERS))
        times = F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in TIME_KEYS])
        return F.struct(
            F.coalesce(number(F.coalesce(F.get(p, 1), first_key(m, VALUE_KEYS))), F.when(length > 0, length.cast("double"))).alias("multiplier"),
            F.coalesce(F.coalesce(F.get(p, 2), F.try_element_at(m, F.lit("timestamp"))).try_cast("double").cast("long"), F.unix_millis(F.try_to_timestamp(times)), F.lit(now)).alias("timestamp"),
            F.coalesce(F.get(p, 0), first_key(m, ID_KEYS)).try_cast("double").cast("long").alias("given"),
            F.coalesce(first_key(m, ("roundId", "round_id", "id", "gameId", "gameRoundId", "uuid", "hash", *TIME_KEYS)), F.lit("")).alias("seed"),
        )

    def named(x: Column) -> Column:
        made = F.coalesce(x["given"], synthetic_id(x["seed"], x["multiplier"], x["timestamp"]))
        return F.struct(x["multiplier"].alias("multiplier"), x["timestamp"].alias("timestamp"), made.alias("round_id"))

    is_tuple = F.ltrim(r).startswith("[")
    parsed = F.struct(F.when(~is_tuple, fields_of(r)).alias("fields"), F.when(is_tuple, F.from_json(r, "array<string>")).alias("parts"))
    found = F.transform(F.transform(F.array(parsed), seen), named)
    usable = F.filter(found, lambda x: x["multiplier"].isNotNull() & x["round_id"].isNotNull())
    return rows.select("*", F.explode(usable).alias("_x")).select(*rows.columns, "_x.*")


# What raises and lowers the score of an address as a feed.
SCORES = ((r"rounds?", 6), (r"history", 5), (r"crash", 4), (r"game", 3), (r"ws|socket", 3), (r"api", 4), (r"dealer", 4), (r"live", 2), (r"recent", 2), (r"\?limit=\d+", 1), (r"cdn|google|sentry|fontawesome|analytics|facebook|twitter|telegram|discord", -8), (r"\.(js|css|png|jpg|jpeg|gif|webp|svg)(\?|$)", -10))
NO_FEED = r"(api|round|history|ws|socket|game|dealer|crash)"


def address_score(url: Column, origin: Column) -> Column:
    low = F.lower(url)
    out = F.when(F.contains(low, origin), 6).otherwise(0) + F.when(low.rlike(NO_FEED), 0).otherwise(-3)
    for pattern, points in SCORES:
        out = out + F.when(low.rlike(pattern), points).otherwise(0)
    return out


def game_key(url: Column) -> Column:
    """Origin and path in lower case, without slashes at the end, query and
    fragment."""
    trimmed = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", "")
    return F.lower(F.regexp_replace(trimmed, r"[?#].*$", ""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


# Fixed value: what a page that asks for a browser says.
CHALLENGE = "(?i)just a moment|enable javascript and cookies|cf-challenge|challenge-platform"


def is_challenge(page: Column) -> Column:
    return F.coalesce(page, F.lit("")).rlike(CHALLENGE)


def resolved(address: Column, base: Column) -> Column:
    """An address as it is meant on the page base: whole, without scheme, from the
    root, a query or fragment of the page, or beside the page; dot segments go."""
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    bare = F.regexp_replace(base, "[?#].*$", "")
    folder = F.concat(origin, F.regexp_replace(F.substr(bare, F.length(origin) + 1, F.length(bare)), "[^/]*$", ""))
    folder = F.when(folder == origin, F.concat(origin, F.lit("/"))).otherwise(folder)
    joined = F.when(address.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), address).when(address.startswith("//"), F.concat(scheme, address)).when(address.startswith("/"), F.concat(origin, address))
    joined = joined.when(address.startswith("?"), F.concat(bare, address)).when(address.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), address)).otherwise(F.concat(folder, address))
    plain = F.regexp_replace(joined, r"/\./", "/")
    for _ in range(4):  # as deep as addresses of feeds go up
        plain = F.regexp_replace(plain, r"(?<![:/])/(?!\.\./)[^/?#]+/\.\./", "/")
    return plain


def host_label(host: Column) -> Column:
    """A name for a host: without www, each of its words with a capital."""
    plain = F.regexp_replace(F.lower(host), "^www[.]", "")
    return F.array_join(F.transform(F.regexp_extract_all(plain, F.lit("[a-z0-9_]+|[^a-z0-9_]+"), F.lit(0)), lambda w: F.initcap(w)), "")
