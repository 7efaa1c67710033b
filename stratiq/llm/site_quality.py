"""Quality by hierarchical empirical Bayes over sites.

Three levels of evidence meet in one score: a classifier of the text itself,
the posterior of the path that the document comes from, and the posterior of
the path's host.  Labelled rows are summed for each host and path; a host's
share of good rows is shrunk towards the global share, a path's towards its
host's, by a Beta prior whose strength is estimated from the spread of the
shares (method of moments).  Sites with few labelled rows, or none, thus keep
their parent's prior.  On the scale of log odds,

    score = text + (path - global),

where ``text`` is a naive Bayes of binned features, learned from a bounded sample
of labelled rows, and already contains the global share.  Its features are shapes
(lengths, symbols, repeats), found by Spark expressions, and words: each hashed
word has log odds, learned on one half of the sample and shrunk towards none, and
a text's mean over its words is a feature whose bins are learned on the other
half.

A labelled document's own label is left out of its path's and host's sums when
the document is scored, so no label enters its own score by way of its site.

Only grouped sums are shuffled (a row for each path and task).  The tables of
sums have a row for each labelled path; they are broadcast if they have at most
``FEW_SITES`` rows and looked up by hot keys and shuffle otherwise.

Defined results
---------------
* Null host or path: a site of its own.  Null text counts as empty.
* Without labelled rows every score is 0.5 and every document is kept.
* Labels other than 0 and 1, and null labels, are ignored; repeated labels of
  one id count once (the smallest).
* Repeated rows count as often as they occur in their site and give equal
  results (one of them is left out); an empty table gives an empty result.
* Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, SPACE, WORD, drawn, looked_up, saved

FEW_SITES = 200_000
#: Shape features: name to a column over _text; each is cut into bins of equal width on the scale given.
BINS = 16
#: Words are hashed to 2^BITS buckets; a bucket's odds are shrunk as by PRIOR rows of the usual mixture.
BITS, PRIOR = 18, 20.0


def _features(text: Column) -> dict[str, Column]:
    words = F.regexp_count(text, F.lit(WORD)).cast("double")
    chars = F.length(text).cast("double")
    rate = lambda n: F.coalesce(n / F.nullif(words, F.lit(0.0)), F.lit(0.0))
    kinds = lambda p: F.length(F.regexp_replace(text, f"[^{p}]+", "")).cast("double")
    capped = lambda x, top: F.least(F.floor(x * BINS / top), F.lit(BINS - 1)).cast("int")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    return {
        "size": capped(F.log2(words + 1), 20.0),
        "length": capped(rate(chars), 16.0),
        "symbols": capped(rate(kinds("#*$%&|<>")), 2.0),
        "marks": capped(rate(kinds("!?")), 2.0),
        "capitals": capped(rate(kinds("A-Z")), 4.0),
        "digits": capped(rate(kinds("0-9")), 2.0),
        "new_lines": capped(F.coalesce(F.size(F.array_distinct(lines)) / F.nullif(F.size(lines), F.lit(0)), F.lit(1.0)), 1.0),
        "new_words": capped(F.coalesce(F.size(F.array_distinct(F.split(F.lower(text), f"[{SPACE}]+"))) / F.nullif(words, F.lit(0.0)), F.lit(1.0)), 1.0),
    }


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def strength(total: float, squares: float, spread: float, groups: float, mean: float) -> float:
    """Rows that the prior is worth, from sums over the groups: n, n squared, n times the squared deviation, and their number.

    Moments of a beta-binomial, within 1 to 1000.
    """
    if groups < 2 or not 0 < mean < 1:
        return 10.0
    between = (spread - (groups - 1) * mean * (1 - mean)) / max(total - squares / total, 1e-9)
    if between <= 0:
        return 1000.0
    return min(1000.0, max(1.0, mean * (1 - mean) / between - 1))


def _sums(groups: DataFrame, mean: float) -> float:
    row = groups.filter("_n > 1").agg(
        F.sum("_n").cast("double"), F.sum(F.col("_n") * F.col("_n")).cast("double"), F.sum(F.col("_n") * (F.col("_good") / F.col("_n") - F.col("_parent")) ** 2), F.count(F.lit(1))
    ).first()
    return strength(row[0] or 0.0, row[1] or 0.0, row[2] or 0.0, row[3], mean)


def posteriors(marked: DataFrame) -> tuple[float, float, float, DataFrame, DataFrame]:
    """The global share of good rows, what the priors of hosts and of paths are worth in rows, and the sums of hosts and of paths.

    ``marked``: _host, _path, _good (0 or 1).  The sums: _site (host, or host and path) and _sums (good, rows).
    """
    paths = saved(marked.groupBy("_host", "_path").agg(F.sum("_good").alias("_good"), F.count(F.lit(1)).alias("_n")), "sites")
    both = paths.agg(F.sum("_good"), F.sum("_n")).first()
    mean = (both[0] + 1.0) / (both[1] + 2.0) if both[1] else 0.5
    hosts = saved(paths.groupBy("_host").agg(F.sum("_good").alias("_good"), F.sum("_n").alias("_n")).withColumn("_parent", F.lit(mean)), "hosts")
    m = _sums(hosts, mean)
    parents = hosts.select(F.col("_host").alias("_h"), ((F.col("_good") + m * F.col("_parent")) / (F.col("_n") + m)).alias("_parent"))
    k = _sums(paths.join(parents, F.col("_host").eqNullSafe(F.col("_h"))), mean)
    sums = F.struct(F.col("_good").alias("good"), F.col("_n").alias("n")).alias("_sums")
    return mean, m, k, hosts.select(_key("_host").alias("_site"), sums), paths.select(_key("_host", "_path").alias("_site"), sums)


def _key(*columns: str) -> Column:
    """A text that is never null and differs where the columns differ."""
    return F.concat(*[F.coalesce(F.concat(F.lit("="), F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns])


class _Odds(dict):
    """Log odds of words, for at most a million of them at a time."""

    def __init__(self, odds: np.ndarray):
        super().__init__()
        self.odds = odds.tolist()

    def __missing__(self, word: bytes) -> float:
        if len(self) >= 1_000_000:
            self.clear()
        found = self[word] = self.odds[zlib.crc32(word) & ((1 << BITS) - 1)]
        return found

    def mean(self, text: str | None) -> float:
        words = (text or "").lower().encode("utf-8", "surrogatepass").split()
        return math.fsum(map(self.__getitem__, words)) / len(words) if words else 0.0


def word_odds(texts: DataFrame) -> np.ndarray:
    """Of each bucket of words, the log odds that a row that has it is good, less those of all rows.  ``texts``: _good, _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column(0), batch.column(1), strict=True):
                words = {zlib.crc32(w) & ((1 << BITS) - 1) for w in text.as_py().lower().encode("utf-8", "surrogatepass").split()}
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), y.as_py(), np.int32)), pa.array(sorted(words), pa.int32())], names=["_good", "_bucket"])

    # At most two rows for each bucket.
    found = texts.mapInArrow(run, "_good int, _bucket int").groupBy("_good", "_bucket").agg(F.count(F.lit(1)).alias("_n")).toArrow()
    seen = np.zeros((2, 1 << BITS))
    seen[found["_good"].to_numpy(), found["_bucket"].to_numpy()] = found["_n"].to_numpy()
    usual = np.clip(seen.sum(axis=1) / max(1.0, seen.sum()), 1e-6, 1)
    return np.log((seen[1] + PRIOR * usual[1]) / (seen[0] + PRIOR * usual[0])) - math.log(usual[1] / usual[0])


def _text_score(rows: DataFrame, good: DataFrame, count: int, mean: float, sample_rows: int) -> tuple[Column, Column]:
    """The words' feature, to be named _words, and the log odds of a row with _text and _words; from at most about ``sample_rows`` labelled rows."""
    features, base = _features(F.col("_text")), F.lit(math.log(mean / (1 - mean)))
    sample = good.filter(drawn("_id", "site", sample_rows / count)).withColumn("_half", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)))
    texts = saved(rows.join(F.broadcast(sample), "_id").select("_good", "_half", "_text"), "site-sample")
    shared = rows.sparkSession.sparkContext.broadcast(word_odds(texts.filter("_half = 0").select("_good", "_text")))

    @F.pandas_udf("double")
    def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        odds = _Odds(shared.value)
        for batch in batches:
            yield batch.map(odds.mean).astype("float64")

    lexical = words(F.col("_text"))
    cuts = texts.filter("_half = 1").select(F.percentile_approx(lexical, [i / BINS for i in range(1, BINS)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    place = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]).cast("array<double>"), lambda x: x < F.col("_words")))
    binned = texts.select("_good", "_half", "_text", lexical.alias("_words")).select("_good", "_half", place.alias("words"), *[c.alias(n) for n, c in features.items()])
    pairs = binned.select("_good", "_half", F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("b")) for n in ("words", *features)])).alias("x"))
    table = {(r["f"], r["b"], r["_good"]): r["n"] for r in pairs.filter("x.f <> 'words' or _half = 1").groupBy("x.f", "x.b", "_good").agg(F.count(F.lit(1)).alias("n")).collect()}
    for name, col in {"words": place, **features}.items():
        total = [sum(table.get((name, b, y), 0) for b in range(BINS)) for y in (0, 1)]
        odds = [math.log((table.get((name, b, 1), 0) + 0.5) / (total[1] + BINS / 2)) - math.log((table.get((name, b, 0), 0) + 0.5) / (total[0] + BINS / 2)) for b in range(BINS)]
        base = base + F.element_at(F.array(*[F.lit(x) for x in odds]), col + 1)
    return lexical, base


def score(
    docs: DataFrame, labels: DataFrame, host: Column | str = "source", path: Column | str = "lang", id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_rows: int = 20_000, threshold: float = 0.5,
) -> DataFrame:
    """One row per input row: id, text_score, site_prior, score (0 to 1), kept."""
    column = lambda c: F.col(f"`{c}`") if isinstance(c, str) else c
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), column(host).cast("string").alias("_host"), column(path).cast("string").alias("_path"))
    good = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_good"))
    good = saved(good, "site-labels")
    count = good.count()
    labelled = lambda df: df.join(F.broadcast(good) if count <= FEW_ROWS else good, "_id", "left")
    mean, m, k, hosts, paths = posteriors(rows.select("_id", "_host", "_path").join(F.broadcast(good) if count <= FEW_ROWS else good, "_id"))
    base = F.lit(math.log(mean / (1 - mean)))
    lexical, total = _text_score(rows, good, count, mean, sample_rows) if count else (F.lit(0.0), base)
    scored = rows.select("_id", _key("_host").alias("_h"), _key("_host", "_path").alias("_p"), "_text", lexical.alias("_words")).select("_id", "_h", "_p", total.alias("_t"))
    own, above = paths.select(F.col("_site").alias("_p"), F.col("_sums").alias("_own")), hosts.select(F.col("_site").alias("_h"), F.col("_sums").alias("_above"))
    if paths.limit(FEW_SITES + 1).count() <= FEW_SITES:
        joined = scored.join(F.broadcast(own), "_p", "left").join(F.broadcast(above), "_h", "left")
    else:
        joined = looked_up(looked_up(saved(scored, "site-scores"), "_p", own, "_own", how="left"), "_h", above, "_above", how="left")
    joined = labelled(joined.filter("_id is not null")).unionByName(joined.filter("_id is null").withColumn("_good", F.lit(None).cast("int")))
    one, y = F.col("_good").isNotNull().cast("int"), F.coalesce("_good", F.lit(0))
    shrunk = lambda sums, worth, parent: (F.coalesce(f"{sums}.good", F.lit(0)) - y + worth * parent) / (F.coalesce(f"{sums}.n", F.lit(0)) - one + worth)
    prior = shrunk("_own", k, shrunk("_above", m, F.lit(mean)))
    sigmoid = lambda x: 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(50.0)), F.lit(-50.0))))
    out = joined.select(F.col("_id").alias(id_col), sigmoid(F.col("_t")).alias("text_score"), prior.alias("site_prior"), sigmoid(F.col("_t") + _logit(prior) - base).alias("score"))
    return out.withColumn("kept", F.col("score") >= threshold)
