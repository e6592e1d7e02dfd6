"""URL filter: longest-rule verdicts, and gradient-boosted trees on lexical features where no rule fits.

A rule ``host/path`` fits its host and every subdomain of it where the URL's path starts with the rule's path; of
several the longest wins.  Other URLs are judged by boosted trees over lexical features (lengths, depth, shares of
digits, entropy, parameter counts, statistics of host suffixes), fitted on a bounded sample of labelled URLs; by
default the URLs that a rule decides are the labelled ones.  Features are Spark columns; only the trees run in numpy,
over batches of features, and only for URLs that no rule decides.

Defined cases: a null url, or one without ``://``, has an empty host and path and the features of its text (none of
null); without labelled URLs, or with labels of one kind only, that kind (allow if none) is everyone's verdict; a URL
that repeats is learnt from once a label; a URL of any length is read whole, and only its features travel; an empty
table gives no rows; extra and clashing columns have no effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import hashed_sample, text_batches
from weftgraph.llm.trees import Boosted, fit_boosted

Rules = tuple[tuple[str, str], ...]
#: Distinct labelled URLs learnt from at most: those with the smallest hash of the URL.
SAMPLE_ROWS = 10_000
#: Features of the URL itself; two statistics of its host's suffix follow.
NAMES = ("length", "host_length", "path_length", "depth", "labels", "digits", "path_digits", "marks", "entropy", "host_entropy", "parameters", "query_length", "fragment", "secure", "longest_label")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    empty = F.lit("")
    return F.when(has, F.translate(host, _UPPER, _LOWER)).otherwise(empty), F.when(has, path).otherwise(empty)


def rule_columns(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits; rules are (verdict, text)."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    rule = verdict = None
    for kind, text in ordered:
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def entropy(text: Column) -> Column:
    """Bits per character of a text's own distribution; 0 for an empty one."""
    n = F.length(text).cast("double")
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n / F.length(c)
    bits = F.aggregate(F.transform(letters, share), F.lit(0.0), lambda total, p: total - p * F.log2(p))
    return F.when(n > 0, bits).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> Column:
    """The features of a URL in the order of ``NAMES``, as an array of doubles."""
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    share = lambda text, pattern: count(text, pattern) / F.greatest(F.lit(1), F.length(text))
    before = F.substring_index(url, "#", 1)
    fragment = F.greatest(F.lit(0), F.length(url) - F.length(before) - 1)
    query = F.greatest(F.lit(0), F.length(before) - F.length(F.substring_index(before, "?", 1)) - 1)
    ands = count(F.right(before, query), "&")
    labels = F.split(host, r"\.")
    values = (
        F.length(url), F.length(host), F.length(path), count(path, "/"), F.when(host == "", 0).otherwise(F.size(labels)), share(url, r"\p{Nd}"), share(path, r"\p{Nd}"), share(url, r"[^\p{L}\p{N}]"),
        entropy(url), entropy(host), F.when(query > 0, ands + 1).otherwise(0), query, fragment, F.startswith(url, F.lit("https:")).cast("int"), F.array_max(F.transform(labels, lambda x: F.length(x))),
    )
    return F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values])


def suffix_key(host: Column) -> Column:
    """A hash of the last two labels of a host, by which suffix statistics are kept."""
    return F.xxhash64(F.substring_index(host, ".", -2))


@dataclass
class UrlModel:
    """Boosted trees, and the sample's statistics of host suffixes by their hash, in order."""

    boosted: Boosted
    keys: np.ndarray
    statistics: np.ndarray

    def probability(self, features: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
        """P(block) of rows of features."""
        return self.boosted.probability(np.concatenate([features, self._of(suffixes)], axis=1))

    def _of(self, suffixes: np.ndarray) -> np.ndarray:
        """Share of the sample and share of blocked URLs of each suffix; 0 and a half where it is unknown."""
        out = np.tile(np.array([[0.0, 0.5]]), (len(suffixes), 1))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, suffixes), len(self.keys) - 1)
            known = self.keys[at] == suffixes
            out[known] = self.statistics[at[known]]
        return out


def fit_features(features: np.ndarray, suffixes: np.ndarray, y: np.ndarray) -> UrlModel:
    """Suffix statistics and boosted trees of a sample."""
    keys, which = np.unique(suffixes, return_inverse=True)
    n, blocked = np.bincount(which, minlength=len(keys)), np.bincount(which, weights=y, minlength=len(keys))
    model = UrlModel(Boosted(-1.0, 0.0, []), keys, np.stack([n / max(1, len(y)), (blocked + 0.5) / (n + 1)], axis=1))
    if len(y):
        model.boosted = fit_boosted(np.concatenate([features, model._of(suffixes)], axis=1), y, trees=40, depth=3, rate=0.3)
    return model


def fit(labelled: DataFrame, *, url_col: str = "url", label_col: str = "verdict", sample: int = SAMPLE_ROWS) -> UrlModel:
    """Trees for P(block) from at most ``sample`` distinct URLs labelled allow or block."""
    rows = labelled.where(F.col(label_col).isin("allow", "block") & F.col(url_col).isNotNull())
    chosen = hashed_sample(rows.select(F.col(url_col).cast("string").alias("u"), (F.col(label_col) == "block").cast("double").alias("y")), "u", sample)
    host, path = host_and_path(F.col("u"))
    split = chosen.select("u", "y", host.alias("h"), path.alias("p"))
    got = split.select("y", lexical(F.col("u"), F.col("h"), F.col("p")).alias("x"), suffix_key(F.col("h")).alias("s")).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(NAMES))
    return fit_features(x, got["s"].to_numpy(np.int64), got["y"].to_numpy(float))


def judge(pages: DataFrame, rules: Rules, *, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, p_block of every row; p_block is null where a rule decides.

    ``labelled`` has columns ``url_col`` and ``verdict``; without it the URLs that rules decide are learnt from.
    """
    text_batches(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    split = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = split.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    model = fit(ruled, url_col="url", label_col="ruled") if labelled is None else fit(labelled, url_col=url_col)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # trees and suffixes of a bounded sample
    made = F.when(F.col("ruled").isNull(), lexical(F.coalesce("url", F.lit("")), F.col("host"), F.col("path")))
    rows = ruled.select("page_id", "host", "path", "rule", "ruled", made.alias("x"), suffix_key(F.col("host")).alias("s"))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name not in ("x", "s")), T.StructField("p_block", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            open_rows = batch.column("x").is_valid().to_numpy(zero_copy_only=False)
            p, at = np.full(batch.num_rows, np.nan), np.flatnonzero(open_rows)
            if len(at):
                x = batch.column("x").flatten().to_numpy().reshape(len(at), len(NAMES))
                p[at] = known.probability(x, batch.column("s").to_numpy()[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(p, mask=~open_rows)], names=schema.names)

    scored = rows.mapInArrow(run, schema)
    method = F.when(F.col("p_block") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "p_block")
