"""Secret scans with character Markov models; DataFrame functions only.

Two first-order models over character classes are trained from labelled samples,
one of random strings, one of ordinary identifiers. A token's score is the sum
of the log-likelihood ratios of its first character and its neighbouring pairs,
divided by their number; tokens above the threshold are reported as kind ``markov``.
Key=value, access key and hex rules give the base spans, which always stay; a markov
span that overlaps a base span isn't reported again.

The labelled samples are what the base rules find in the scanned table (random) and
its words of ``LEAST_WORD`` letters or more (ordinary), counted over all its rows,
beside generated keys and identifiers, so that a table without secrets trains too;
any labelled table can be given instead. What comes to the driver is a count for each
pair of alphabet characters and label.

Offsets are code points, end exclusive. They come from splitting the text at the
matches: the pieces' and matches' lengths add up to the positions. Matches are gone
through in blocks of ``BLOCK``, so that no array is copied at each match and spans are
compared with the blocks that they touch only.

Cases: null text counts as empty; empty text has no spans; texts of any length are
scanned whole; of spans with one start the kinds stand in their order; repeated rows
each give their row; null ids are ids like others; other columns are ignored, or
carried along by ``scan`` whatever their names but its results'; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The lengths are in the patterns: a run that is too short for its start is too short for any later start in it.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: A run of the alphabet that is long enough for the ratio to tell.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
THRESHOLD = 0.55
SMOOTHING = 0.5
BLOCK = 256
#: Words of the scanned table that count as ordinary.
LEAST_WORD = 8
ORDINARY = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z]{{{LEAST_WORD},}}(?![A-Za-z0-9+/_=-])"

#: Parts of the ordinary identifiers in the built-in labelled sample.
WORDS = (
    "account address after array before buffer build cache call change check class client close code column command config connection content context control copy count create "
    "current data date default delete description detail device document double element email enable end entry error event example expected export field file filter final find first "
    "folder format from function general group handler header height host image import index information initial input instance integer interface internal invoice item key label language "
    "last length level library limit line list load local location logger manager match message method model module monitor name network node number object offset open operator option order "
    "output package page parameter parent parse path pattern payment point policy position previous process product profile project property provider query queue range read record reference "
    "region register remote remove render report request resource response result return root route row sample schedule schema score search section select sequence server service session setting "
    "shadow source space start state status storage stream string style summary switch system table target task template test text thread time title token total transaction transfer tree type "
    "update upload user validate value vector version view visible warning weight width window worker write the and that with this have from they which there would about their other"
).split()


def labelled_sample(n: int = 4000, seed: int = 11) -> list[tuple[str, int]]:
    """(token, 1 if random): generated keys in common alphabets, and identifiers joined from words."""
    r = random.Random(seed)
    sets = ["0123456789abcdef", ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "_-", ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62]]
    out = [("".join(r.choices(sets[i % len(sets)], k=r.randint(20, 64))), 1) for i in range(n)]
    for i in range(n):
        w = [r.choice(WORDS) for _ in range(r.randint(2, 6))]
        kind = i % 6
        t = ["_".join(w), "-".join(w), "/".join(w), "".join(x.title() for x in w), "".join(w), "_".join(w).upper()][kind]
        out.append((t + (f"{'_-'[i % 2]}{r.randint(0, 2030)}" if r.random() < 0.3 else ""), 0))
    return out


def found_sample(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, random): what the base rules find in the table's texts, and their long words."""
    t = F.col(f"`{text_col}`").cast("string")
    values = F.filter(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= 8)
    secret = F.concat(values, F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(t, F.lit(HEX), F.lit(0)))
    each = lambda tokens, label: F.transform(tokens, lambda x: F.struct(x.alias("token"), F.lit(label).alias("random")))
    both = F.concat(each(secret, 1), each(F.regexp_extract_all(t, F.lit(ORDINARY), F.lit(0)), 0))
    return df.filter(t.isNotNull()).select(F.explode(both).alias("s")).select("s.token", "s.random")


def pair_ratios(sample: DataFrame, text_col: str = "token", label_col: str = "random") -> list[float]:
    """Log-likelihood ratio of each pair of alphabet characters (row-major), then of each first character, from a labelled DataFrame.

    The result has ``len(ALPHABET) * (len(ALPHABET) + 1)`` numbers whatever the sample's size."""
    n = len(ALPHABET)
    chars = sample.filter(F.col(text_col).isNotNull()).select(F.col(label_col).cast("int").alias("y"), F.split(text_col, "").alias("c"))
    pairs = chars.filter("size(c) > 1").select("y", F.explode(F.expr("transform(sequence(0, size(c) - 1), i -> struct(if(i = 0, '', c[i - 1]) as a, c[i] as b))")).alias("p"))
    counted = pairs.filter(f"instr('{ALPHABET}', p.a) > 0 and instr('{ALPHABET}', p.b) > 0").groupBy("y", "p.a", "p.b").count().collect()
    count = [[[SMOOTHING] * n for _ in range(n + 1)] for _ in range(2)]
    for y, a, b, k in counted:
        count[y][ALPHABET.index(a) if a else n][ALPHABET.index(b)] += k
    total = [[sum(row) for row in count[y]] for y in range(2)]
    return [math.log(count[1][i][j] / total[1][i]) - math.log(count[0][i][j] / total[0][i]) for i in range(n + 1) for j in range(n)]


def trained(spark: SparkSession, sample: list[tuple[str, int]] | DataFrame | None = None, found_in: DataFrame | None = None) -> list[float]:
    """The ratios of a labelled sample, by default the generated one, and of what is found in a table."""
    rows = labelled_sample() if sample is None else sample
    labelled = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, "token string, random int")
    return pair_ratios(labelled if found_in is None else labelled.unionByName(found_sample(found_in)))


def ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's first character and pairs; positive: random."""
    n = len(ALPHABET)
    table = F.from_json(F.lit(json.dumps([round(x, 5) for x in ratios])), "array<double>")
    code = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    first = lambda c: F.coalesce(F.get(table, F.lit(n * n) + F.get(c, F.lit(0))), F.lit(0.0))
    return F.transform(F.array(code), lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), first(c), lambda s, i: s + F.coalesce(F.get(table, F.get(c, i - 1) * n + F.get(c, i)), F.lit(0.0))) / F.size(c))[0]


def _matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """All matches, leftmost and not overlapping, and the pieces between them (none if no match)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found, F.when(F.size(found) > 0, F.split(text, pattern, -1))


SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(found: Column, pieces: Column, kind: int, keep) -> Column:
    """array<struct<start, kind, end>> of the matches that ``keep`` accepts."""
    none = F.array().cast(SPANS)

    def step(acc: Column, i: Column) -> Column:
        m = F.get(found, i)
        start = acc["at"] + F.length(F.get(pieces, i))
        end = start + F.length(m)
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(keep(m), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        last = F.least(F.size(found), (b + 1) * BLOCK) - 1
        one = F.aggregate(F.sequence(b * BLOCK, last), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.transform(F.array(one), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0]

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
    return F.when(F.size(found) > 0, F.flatten(F.aggregate(blocks, start, block)["out"])).otherwise(none)


def _blocks(spans: Column) -> Column:
    """Sorted spans in blocks, each with its least start and greatest end."""
    at = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int"))
    part = lambda i: F.slice(spans, i * BLOCK + 1, BLOCK)
    one = lambda p: F.struct(F.get(p, F.lit(0))["start"].alias("low"), F.array_max(F.transform(p, lambda s: s["end"])).alias("high"), p.alias("spans"))
    return F.when(F.size(spans) > 0, F.transform(F.transform(at, part), one)).otherwise(F.array().cast(f"array<struct<low:int,high:int,spans:{SPANS}>>"))


def scan(df: DataFrame, ratios: list[float], *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``secret_base`` and ``secret_spans``: arrays of (start, kind, end), kind an index of ``KINDS``."""
    rules = {
        "assign": (ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
        "access": (ACCESS, lambda m: F.lit(True)),
        "hex": (HEX, lambda m: F.lit(True)),
        "markov": (TOKEN, lambda m: ratio(m, ratios) > threshold),
    }
    own = [c for c in df.columns if c.lower() not in ("secret_base", "secret_spans")]
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    out = out.withColumns({f"f_{k}": _matches(F.col("t"), p)[0] for k, (p, _) in rules.items()})
    out = out.withColumns({f"p_{k}": F.when(F.size(f"f_{k}") > 0, F.split("t", p, -1)) for k, (p, _) in rules.items()})
    out = out.withColumns({f"s_{k}": _spans(F.col(f"f_{k}"), F.col(f"p_{k}"), KINDS.index(k), keep) for k, (_, keep) in rules.items()})
    out = out.withColumn("base", F.array_sort(F.concat("s_assign", "s_access", "s_hex"))).withColumn("blocks", _blocks(F.col("base")))
    meets = lambda x, y: (x["start"] < y["end"]) & (y["start"] < x["end"])
    near = lambda x: F.exists("blocks", lambda b: (b["low"] < x["end"]) & (x["start"] < b["high"]) & F.exists(b["spans"], lambda y: meets(x, y)))
    added = F.filter("s_markov", lambda x: ~near(x))
    return out.select("row.*", F.col("base").alias("secret_base"), F.array_sort(F.concat("base", added)).alias("secret_spans"))


def rendered(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(df: DataFrame, ratios: list[float], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = scan(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), ratios, text_col=text_col)
    n = lambda k: F.size(F.filter("secret_base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select(F.col(f"`{id_col}`"), n("assign"), n("access"), n("hex"), F.sha2(rendered(F.col("secret_base")), 256).alias("base_sha256"), rendered(F.col("secret_spans")).alias("spans"))
