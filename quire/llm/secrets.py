"""Operator 2: secrets in whole texts, with DataFrame functions alone.

Three fixed patterns give the base spans. Java's regular expressions return matches without
their places, so a text is also split by the same pattern: the lengths of the pieces between
matches and of the matches themselves add up to the places, in code points.

The method adds what the patterns miss. Two character Markov models of first order, one of
random strings and one of ordinary identifiers, are trained from labelled samples; a string
of the alphabet of secrets is a finding when the log-likelihood ratio of its transitions, random
against ordinary, exceeds a threshold. The threshold is calibrated on labelled samples that the
models were not trained on: it is the least that lets through a given share of ordinary ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the base patterns, in the order in which kinds are listed. A run of the two
# last that is too short holds no longer one, so their least lengths stand in the pattern.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
ASSIGN_LEAST = 6

#: A candidate of the method: a whole run of these, of at least so many, with a digit and a letter.
MARKOV, MARKOV_LEAST = "markov", 12
PATTERNS[MARKOV] = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{%d,}" % MARKOV_LEAST
#: The share of ordinary samples that calibration lets through.
FALSE_SHARE = 0.002

#: The alphabet of the models; every other character counts as one more symbol.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
_SYMBOLS = len(ALPHABET) + 1

#: Parts of ordinary identifiers, a plain list; samples are made from them by rule.
PARTS = (
    "user name value index count total first last item list table column row page file path "
    "data text line block cell key map node edge start end left right top bottom width height "
    "size length offset buffer stream reader writer parser result error message status code "
    "type kind class method field record event handler factory builder manager service client "
    "server request response session config option setting default update create delete insert "
    "select filter group order join window batch queue task worker thread process memory cache "
    "local global public private static final number string integer double float array vector "
    "matrix image color color frame layer model train test sample label score weight bias "
    "version release change commit branch merge review report section chapter summary account "
    "customer invoice payment address street city country region supplier product quantity price "
    "date time hour minute second month year"
).split()


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratios of transitions, row by row, and the threshold of a string's sum of them."""

    ratios: tuple[float, ...]
    threshold: float


def labelled_samples(spark: SparkSession, n: int = 3000, seed: int = 11) -> DataFrame:
    """``n`` labelled strings of each kind, made by rule: (sample string, random boolean).

    Random: 12 to 32 characters of lower-case hex, base64 and mixed letters. Ordinary: two to five parts of
    names joined in the usual ways, often with a number, or numbers, dates and hyphened words. Another
    ``seed`` gives other samples.
    """
    i = F.col("id")
    h = F.sha2(F.concat(F.lit(f"{seed}:"), i.cast("string")), 256)
    word = F.array(*(F.lit(p) for p in PARTS))

    def part(k: int) -> Column:
        return F.element_at(word, (F.pmod(F.xxhash64(i, F.lit(seed + k)), F.lit(len(PARTS))) + 1).cast("int"))

    def up(c: Column) -> Column:
        return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 99))

    number = F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(10_000)).cast("string")
    base64 = F.regexp_replace(F.base64(F.unhex(h)), "=", "")
    size = (F.pmod(F.xxhash64(i, F.lit(seed + 9)), F.lit(21)) + 12).cast("int")
    rand = F.when(i % 3 == 0, h).when(i % 3 == 1, base64).otherwise(F.regexp_replace(base64, "[+/]", ""))
    rand = F.substr(rand, F.lit(1), size)
    plain = (
        F.when(i % 6 == 0, F.concat_ws("_", part(1), part(2), part(3), number))
        .when(i % 6 == 1, F.concat(part(1), up(part(2)), up(part(3)), number))
        .when(i % 6 == 2, F.concat_ws("-", part(1), part(2), part(3), part(4)))
        .when(i % 6 == 3, F.concat(up(part(1)), up(part(2)), up(part(3))))
        .when(i % 6 == 4, F.concat_ws("/", part(1), part(2), F.concat(part(3), number), part(4)))
        .otherwise(F.concat(part(1), part(2), part(3), F.lit("-2"), number))
    )
    ids = spark.range(n)
    return ids.select(rand.alias("sample"), F.lit(True).alias("random")).unionByName(
        ids.select(plain.alias("sample"), F.lit(False).alias("random"))
    )


def _symbols(text: Column) -> Column:
    """The positions of a string's characters in the alphabet, from 0; the last is any other."""
    at = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.transform(at, lambda p: F.when(p == 0, F.lit(_SYMBOLS - 1)).otherwise(p - 1))


def _pairs(text: Column) -> Column:
    """Indexes of a string's transitions into a row-by-row table."""
    s = _symbols(text)
    return F.zip_with(
        F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))),
        F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))),
        lambda a, b: a * _SYMBOLS + b,
    )


def train(samples: DataFrame, held: DataFrame, smoothing: float = 0.5) -> MarkovModel:
    """Fit both models from labelled strings (``sample``, ``random``) and calibrate on ``held`` ones.

    What reaches the driver is one row for each transition of the alphabet that occurs, so at
    most the square of its size, and one number. Null and one-character samples teach nothing; with no
    samples every ratio is 0, and without ordinary ones in ``held`` nothing exceeds the threshold.
    """
    counted = (
        samples.filter(F.length("sample") > 1)
        .select("random", F.explode(_pairs(F.col("sample"))).alias("pair"))
        .groupBy("pair")
        .agg(F.sum(F.col("random").cast("long")).alias("r"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    size = _SYMBOLS
    tables = [[smoothing] * (size * size) for _ in range(2)]
    for row in counted:
        tables[0][row["pair"]] += row["r"]
        tables[1][row["pair"]] += row["n"] - row["r"]
    ratios = []
    for a in range(size):
        rows = [t[a * size : (a + 1) * size] for t in tables]
        sums = [sum(r) for r in rows]
        ratios += [math.log(x / sums[0]) - math.log(y / sums[1]) for x, y in zip(*rows)]
    ratios = tuple(round(x, 4) for x in ratios)
    ordinary = held.filter("not random").select(log_ratio(F.col("sample"), ratios).alias("score"))
    least = ordinary.agg(F.percentile("score", F.lit(1 - FALSE_SHARE))).first()[0]
    return MarkovModel(ratios, math.inf if least is None else round(max(0.0, least), 4))


def log_ratio(text: Column, ratios: tuple[float, ...]) -> Column:
    """The log-likelihood ratio of a string's transitions; 0 for fewer than two characters."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    return F.aggregate(_pairs(text), F.lit(0.0), lambda acc, p: acc + F.get(table, p))


def _placed(kind: str) -> Column:
    """The matches of a kind, ``__hit_<kind>``, with their places in ``__text``: (start, rank, end, hit)."""
    hits = F.col(f"__hit_{kind}")
    rank = [*KINDS, MARKOV].index(kind)
    span = "array<struct<start:int,rank:int,end:int,hit:string>>"
    pairs = F.zip_with(
        hits,
        F.slice(F.split("__text", PATTERNS[kind], -1), F.lit(1), F.size(hits)),
        lambda hit, gap: F.struct(hit.alias("hit"), F.length(gap).alias("gap")),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    none = F.array().cast(span)
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, zero, step)["out"]).otherwise(none)


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def find_secrets(docs: DataFrame, model: MarkovModel) -> DataFrame:
    """All columns of ``docs`` with ``base`` and ``added``: arrays of (start, rank, end, hit).

    ``rank`` numbers the kinds assign, access, hex, markov from 0. Base spans are the leftmost
    matches of each kind that do not overlap; an assignment counts from six characters of value.
    ``added`` holds what only the models find: candidates that touch no base span. Null text is
    empty and has no spans; rows are independent, so repeated rows repeat their spans.
    """
    if clash := {"base", "added"} & set(docs.columns):
        raise ValueError(f"docs has columns of the result: {sorted(clash)}")
    kinds = [*KINDS, MARKOV]
    rows = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    rows = rows.withColumns({f"__hit_{k}": F.regexp_extract_all("__text", F.lit(PATTERNS[k]), F.lit(0)) for k in kinds})
    rows = rows.withColumns({f"__at_{k}": _placed(k) for k in kinds})
    value = lambda s: F.regexp_extract(s["hit"], PATTERNS["assign"], 2)
    rows = rows.withColumn(
        "base",
        F.array_sort(
            F.concat(F.filter("__at_assign", lambda s: F.length(value(s)) >= ASSIGN_LEAST), F.col("__at_access"), F.col("__at_hex"))
        ),
    )
    free = F.filter(f"__at_{MARKOV}", lambda c: ~F.exists("base", lambda s: _overlaps(s, c)))
    rows = rows.withColumn("__free", free)
    rows = rows.withColumn("added", F.filter("__free", lambda c: log_ratio(c["hit"], model.ratios) > F.lit(model.threshold)))
    return rows.drop("__text", "__free", *(f"__{w}_{k}" for w in ("hit", "at") for k in kinds))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in [*KINDS, MARKOV]))
    one = lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def secret_report(docs: DataFrame, model: MarkovModel) -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    ``spans`` lists kind:start:end of all spans, the models' as markov, by start, then kind as listed, joined by commas;
    ``base_sha256`` digests the same list of base spans alone. Ends are exclusive.
    """
    found = find_secrets(docs.select("doc_id", "text"), model)
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_markov"),
    )


def redact_secrets(docs: DataFrame, model: MarkovModel, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark``, and ``n_chars`` to match.

    Overlapping spans are replaced as one. Texts without spans, and null, stay as they are.
    """
    columns = {c: "text" if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)}
    found = find_secrets(docs.toDF(*columns.values()), model).withColumn("__all", F.array_sort(F.concat("base", "added")))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("__all", zero, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1)))
    hit = F.size("__all") > 0
    out = found.withColumn("text", F.when(hit, done).otherwise(F.col("text")))
    if size := columns.get("n_chars"):
        out = out.withColumn(size, F.when(hit, F.length("text").cast("long")).otherwise(F.col(size)))
    return out.select(*(F.col(own).alias(c) for c, own in columns.items()))
