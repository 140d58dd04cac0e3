"""Personal data by candidate boosting, with DataFrame functions and Spark ML only.

Base spans come from four patterns and their checks. High-recall generators
propose further, overlapping spans of the same kinds (separators of other sorts,
missing prefixes, words such as "at"). Boosted trees rate a candidate by its
format and context; they are trained on two thirds of the candidates of all
documents, labelled by whether they are a base span or pass their kind's check
once written in the usual form (a phone number also needs a word before it that
speaks of one), and a threshold per kind is calibrated on the other third for a precision of at
least 0.99. Candidates above it that touch no base span are added; base spans
always stay.

Starts and ends count code points. Matching uses a pattern twice (matches, and
the text between them), whose lengths add up to the places.

Defined cases: a null or empty text has no spans; documents without candidates of
both labels add none; of overlapping additions the first stays. Rows without id
and repeated rows are searched like any other. Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: fixed patterns of the base spans; the look-behinds only spare restarts inside a run that has failed as a whole, and
#: possessive repeats of groups (nothing follows them) run in a loop, not by recursion, on very long runs
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: a document without this has no match and no candidate
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?(?:@|\(at\)|\[at\])\x20?)[A-Za-z0-9-]+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]{1,4}(?:[.,][0-9]{1,4}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)\x20?[0-9](?:[\x20()./-]{0,2}[0-9]){7,14}(?![0-9])",
}
#: characters of context read on either side
CONTEXT = 24
HINT = {"email": "mail|contact|write", "ip": "ip|host|server|addr", "card": "card|visa|pay|credit", "phone": "phone|call|tel|fax|mobil"}
PRECISION = 0.99
#: bins of a feature; Spark ML looks for split points among max(bins^2, ENOUGH) rows of those it is given
BINS, ENOUGH = 16, 10_000
FEATURES = ["kind", "size", "digits", "letters", "blanks", "dashes", "dots", "others", "groups", "longest", "first_digit", "hint", "before_space", "after_space", "before_digitlike", "distinct", "passes"]


def _holds(text: Column, pattern: str, need: str) -> Column:
    return F.contains(text, F.lit(need)) if need else F.lit(True)


def _spans(text: Column, pattern: str, need: str) -> Column:
    """Array of (start, end, value), leftmost and non-overlapping."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)").alias("out"))

    def add(acc: Column, pair: Column) -> Column:
        start = acc.getField("at") + F.length(pair.getField("gap"))
        end = start + F.length(pair.getField("value"))
        return F.struct(end.alias("at"), F.concat(acc.getField("out"), F.array(F.struct(start.alias("start"), end.alias("end"), pair.getField("value").alias("value")))).alias("out"))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda v, g: F.struct(g.alias("gap"), v.alias("value")))
    spans = F.aggregate(pairs, zero, add, lambda acc: acc.getField("out"))
    return F.when(_holds(text, pattern, need) & text.rlike(pattern), spans).otherwise(F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)"))


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        # leading zeros don't count; what is left of a part up to 255 has at most three digits
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) < 3) | (F.length(part(p)) == 3) & (part(p) <= "255"))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """Valid spans of each kind."""
    def valid(kind: str):
        return lambda s: _valid(kind, s.getField("value"))

    return {k: F.filter(_spans(text, BASE[k], NEEDS[k]), valid(k)) for k in KINDS}


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _passes(kind: str) -> Column:
    """Whether a candidate passes its kind's check once it is written in the usual form."""
    value = F.col("value")
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\(at\)|\[at\]", "@"), r"\(dot\)|\[dot\]", "."), " ", "")
        return plain.rlike("^" + BASE["email"] + "$")
    if kind == "ip":
        return ~F.contains(value, F.lit(",")) & _valid(kind, F.regexp_replace(value, ",", "."))
    return _valid(kind, F.regexp_replace(value, "^00", "") if kind == "phone" else value)


def candidates(rows: DataFrame) -> DataFrame:
    """(doc, tag, kind_name, start, end, features .., is_personal, clear) of every proposed span."""
    text = F.col("text")
    digit = text.rlike("[0-9]") | F.contains(text, F.lit("@")) | F.contains(text, F.lit("at"))
    base = rows.filter(digit).withColumn("base", F.struct(*[c.alias(k) for k, c in base_spans(text).items()]))

    def named(kind: str):
        return lambda s: F.struct(F.lit(kind).alias("kind_name"), *[s.getField(f).alias(f) for f in ("start", "end", "value")])

    each = F.concat(*[F.transform(_spans(text, CANDIDATES[k], ""), named(k)) for k in KINDS])
    found = base.withColumn("each", each).filter(F.size("each") > 0).select("doc", "tag", "text", "base", F.explode("each").alias("c")).select("doc", "tag", "text", "base", "c.*")
    own = F.coalesce(*[F.when(F.col("kind_name") == k, F.col(f"base.{k}")) for k in KINDS])
    whole = F.concat(*[F.col(f"base.{k}") for k in KINDS])
    before = F.substring("text", F.greatest(F.col("start") + 1 - CONTEXT, F.lit(1)), F.least(F.col("start"), F.lit(CONTEXT)))
    after = F.substring("text", F.col("end") + 1, F.lit(CONTEXT))
    left = lambda pattern: F.length(F.regexp_replace("value", f"[^{pattern}]", "")).cast("double")
    groups = F.filter(F.split("value", "[^0-9A-Za-z]+"), lambda g: g != "")
    hint = F.coalesce(*[F.when(F.col("kind_name") == k, F.lower(before).rlike(HINT[k])) for k in KINDS])
    values = {
        "kind": F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind_name")).cast("double"), "size": F.length("value").cast("double"),
        "digits": left("0-9"), "letters": left("A-Za-z"), "blanks": left(" "), "dashes": left("\\-"), "dots": left("."), "others": left("^0-9A-Za-z .\\-").cast("double"),
        "groups": F.size(groups).cast("double"), "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
        "first_digit": F.coalesce(F.expr("try_cast(substr(regexp_replace(value, '[^0-9]', ''), 1, 1) AS double)"), F.lit(-1.0)), "hint": hint.cast("double"),
        "before_space": before.rlike(r"(^|\s)$").cast("double"), "after_space": after.rlike(r"^([\s.,;]|$)").cast("double"),
        "before_digitlike": before.rlike(r"[0-9A-Za-z]$").cast("double"), "distinct": F.size(F.array_distinct(F.split("value", ""))).cast("double"),
    }
    values["passes"] = F.coalesce(*[F.when(F.col("kind_name") == k, _passes(k)) for k in KINDS]).cast("double")
    same = F.exists(own, lambda s: (s.getField("start") == F.col("start")) & (s.getField("end") == F.col("end")))
    touched = F.exists(whole, lambda s: (s.getField("start") < F.col("end")) & (F.col("start") < s.getField("end")))
    return found.select("doc", "tag", "kind_name", "start", "end", *[v.alias(k) for k, v in values.items()], (same | (values["passes"] == 1.0) & ((values["kind"] < 4.0) | hint)).cast("double").alias("is_personal"), (~touched).alias("clear"))


def trained(found: DataFrame):
    """Boosted trees and the threshold of each kind from all candidates, or None if they can't teach any."""
    part = F.pmod(F.xxhash64("doc", "tag", "start"), F.lit(3))
    # equal candidates are one row of their number as weight, which gives the same sums
    alike = found.filter(part > 0).groupBy(*FEATURES, "is_personal").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    fit = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(stage(alike, "pii_alike"))
    kinds, n = fit.agg(F.count_distinct("is_personal"), F.count(F.lit(1))).first()
    if kinds < 2:
        return None
    # so many bins that split points come from every row, not from a sample that Spark ML would draw
    bins = BINS if n <= ENOUGH else max(BINS, math.isqrt(n) + 1)
    model = GBTClassifier(labelCol="is_personal", weightCol="weight", maxIter=8, maxDepth=3, maxBins=bins, seed=7).fit(fit)
    rated = _rated(model, found.filter(part == 0)).groupBy("kind_name", F.floor(F.col("p") * 100).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("is_personal").alias("hits")).collect()
    limits = {}
    for kind in KINDS:
        n = hits = 0
        for r in sorted((r for r in rated if r["kind_name"] == kind), key=lambda r: -r["step"]):
            n, hits = n + r["n"], hits + r["hits"]
            if hits < PRECISION * n:
                break
            limits[kind] = r["step"] / 100
    return model, limits


def _rated(model, found: DataFrame) -> DataFrame:
    rated = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    return rated.withColumn("p", vector_to_array("probability")[1])


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, and arrays of (start, end) by kind: ``base`` and ``added``."""
    rows = _keyed(docs, id_col, text_col)
    ends = lambda a: F.transform(a, lambda s: F.struct(s.getField("start").alias("start"), s.getField("end").alias("end")))
    base = rows.select("doc", "tag", F.struct(*[ends(c).alias(k) for k, c in base_spans(F.col("text")).items()]).alias("base"))
    # candidates of all documents are searched once, for the trees and for what they rate
    found = stage(candidates(rows), "pii_candidates")
    taught = trained(found)
    none = "array<struct<kind:int,start:int,end:int>>"
    if taught is None or not taught[1]:
        return base.select(F.col("doc").alias(id_col), "base", F.expr(f"CAST(array() AS {none})").alias("added"))
    model, limits = taught
    limit = F.coalesce(*[F.when(F.col("kind_name") == k, F.lit(v)) for k, v in limits.items()], F.lit(2.0))
    extra = _rated(model, found.filter("clear")).filter(F.col("p") >= limit)
    # of overlapping additions the first stays; spans of one document are bounded by its length
    extra = extra.select("doc", "tag", F.struct(F.col("start"), F.col("kind").cast("int").alias("kind"), F.col("end")).alias("s")).groupBy("doc", "tag").agg(F.array_sort(F.collect_set("s")).alias("all"))
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS {none})").alias("out"))
    step = lambda acc, s: F.when(s.getField("start") >= acc.getField("at"), F.struct(s.getField("end").alias("at"), F.concat(
        acc.getField("out"), F.array(F.struct(s.getField("kind").alias("kind"), s.getField("start").alias("start"), s.getField("end").alias("end")))).alias("out"))).otherwise(acc)
    extra = extra.select("doc", "tag", F.aggregate("all", zero, step, lambda acc: acc.getField("out")).alias("added"))
    joined = base.join(extra.select(F.coalesce("doc", F.lit(0)).alias("k1"), F.col("doc").isNull().alias("k2"), F.col("tag").alias("k3"), "added"),
                       (F.coalesce("doc", F.lit(0)) == F.col("k1")) & (F.col("doc").isNull() == F.col("k2")) & (F.col("tag") == F.col("k3")), "left")
    return joined.select(F.col("doc").alias(id_col), "base", F.coalesce("added", F.expr(f"CAST(array() AS {none})")).alias("added"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans, the digest of their list, and the list of all spans."""
    def shown(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s.getField("start").cast("string"), F.lit(":"), s.getField("end").cast("string")))

    base = F.array_join(F.concat(*[shown(k, F.col(f"base.{k}")) for k in KINDS]), ",")
    mine = lambda i: F.transform(F.filter("added", lambda s: s.getField("kind") == i + 1), lambda s: F.struct(s.getField("start").alias("start"), s.getField("end").alias("end")))
    every = F.array_join(F.concat(*[shown(k, F.array_sort(F.concat(F.col(f"base.{k}"), mine(i)))) for i, k in enumerate(KINDS)]), ",")
    return found.select(id_col, *[F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"),
                        F.size("added").cast("long").alias("n_added"))
