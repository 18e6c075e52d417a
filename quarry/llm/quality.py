"""Quality rules with host-level verdicts.

Each document is measured against rules; failures of each rule are added up by
host, a host's rate of each rule is shrunk towards the corpus with a beta prior
fitted to all hosts (method of moments), and the verdict on the host comes back
to its documents.  A document itself is judged by the base rule alone; the
others say something of a host, not of a single document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, text

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
RULES = ("base", "symbols", "lines", "length")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _repeated(h: np.ndarray, window: int) -> int:
    """Words inside windows of so many words that the text has twice or more."""
    if len(h) <= window:
        return 0
    g = text.grams(h, window)
    order = np.argsort(g, kind="stable")
    same = g[order][1:] == g[order][:-1]
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    covered = np.zeros(len(h), bool)
    for k in range(window):
        covered[k : k + len(g)] |= twice
    return int(covered.sum())


def _lines(buf: np.ndarray, off: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By document: lines with a word, and how many of them are equal to an earlier line of the document."""
    out = np.zeros(len(off) - 1, np.int64)
    if not len(buf):
        return out, out
    breaks = np.flatnonzero(buf == 10)
    starts = np.concatenate([off[:-1], breaks + 1])
    ends = np.concatenate([off[1:], breaks])
    starts.sort(), ends.sort()
    full = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[full], ends[full]
    h = text.hash_spans(buf, starts, ends)
    at = np.searchsorted(starts, off)
    for i in range(len(out)):
        if at[i + 1] - at[i] > 1:
            out[i] = at[i + 1] - at[i] - len(np.unique(h[at[i] : at[i + 1]]))
    return np.diff(at), out


def _measure(column: pa.Array) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {k: [] for k in MEASURES}
    for _, _, buf, off in text.slices(column):
        starts, ends, at = text.words(buf, off)
        h = text.hash_spans(buf, starts, ends)
        before = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        chars, symbols = before(((buf & 0xC0) != 0x80) & ~text.SPACE[buf]), before(_SYMBOL[buf])
        parts["n_words"].append(np.diff(at))
        parts["word_chars"].append(np.diff(chars[off]))
        parts["n_symbols"].append(np.diff(symbols[off]))
        n_lines, n_dup_lines = _lines(buf, off, starts)
        parts["n_lines"].append(n_lines)
        parts["n_dup_lines"].append(n_dup_lines)
        parts["n_repeat_words"].append(np.array([_repeated(h[a:b], 3) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in parts.items()}


def with_measures(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the measures of its text column, one long column each, named with the prefix.

    A null or empty text has no words and measures 0 throughout; texts of any
    length are measured whole, and rows with equal or null ids each on their
    own.  n_lines counts the lines with a word.  A column of docs that has the
    name of a measure is refused (give a prefix).
    """
    schema = T.StructType(docs.schema.fields + [T.StructField(prefix + k, T.LongType()) for k in MEASURES])
    if len({f.name.lower() for f in schema.fields}) < len(schema.fields):
        raise ValueError("a column of the input has the name of a measure; give a prefix")

    def run(batches):
        for batch in scratch.cut(batches):
            made = _measure(batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(made[k], pa.int64()) for k in MEASURES)], [*batch.schema.names, *(prefix + k for k in MEASURES)])

    return docs.mapInArrow(run, schema)


def base_failed(prefix: str = "", min_words: int = 50, repeat_percent: int = 50) -> Column:
    n = F.col(prefix + "n_words")
    return (n < min_words) | (100 * F.col(prefix + "n_repeat_words") > repeat_percent * n)


def rules(prefix: str = "", symbol_percent: int = 10, dup_line_percent: int = 30, word_length: tuple[int, int] = (2, 12)) -> dict[str, Column]:
    """By rule of RULES: does a document fail it?  Symbols are counted against the characters of words, repeated lines against all lines."""
    m = {k: F.col(prefix + k) for k in MEASURES}
    return {
        "base": base_failed(prefix),
        "symbols": 100 * m["n_symbols"] > symbol_percent * m["word_chars"],
        "lines": 100 * m["n_dup_lines"] > dup_line_percent * m["n_lines"],
        "length": (m["word_chars"] < word_length[0] * m["n_words"]) | (m["word_chars"] > word_length[1] * m["n_words"]),
    }


def host_verdicts(measured: DataFrame, host: str, failed: dict[str, str], max_rate: float = 0.5) -> DataFrame:
    """host, host_docs, for each rule host_failures_ and host_rate_ (shrunk), then host_rate (the largest) and host_rejected.

    One row per host, null being one; failed names the boolean column of each
    rule.  A rule's prior Beta(m*k, (1-m)*k) has the corpus's failure rate m; k
    comes from the variance between hosts beyond binomial noise and lies in
    [1, 1e6].  A host is rejected when one of its rates is above max_rate.
    """
    counts = [F.sum(F.col(c).cast("long")).alias(f"host_failures_{k}") for k, c in failed.items()]
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_docs"), *counts)
    n, f = F.col("host_docs").cast("double"), {k: F.col(f"host_failures_{k}").cast("double") for k in failed}
    sums = hosts.agg(F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(n * n).alias("r"), *(x for k, v in f.items() for x in (F.sum(v).alias(f"f_{k}"), F.sum(v * v / n).alias(f"q_{k}"))))

    def prior(k: str) -> Column:
        m = F.col(f"f_{k}") / F.col("n")
        noise = m * (1 - m)
        between = F.try_divide(F.col(f"q_{k}") - F.col("n") * m * m - noise * (F.col("k") - 1), F.col("n") - F.col("r") / F.col("n"))
        size = F.when((noise > 0) & (between > 0), F.try_divide(noise, between) - 1).otherwise(F.lit(1e6))
        return F.struct(m.alias("m"), F.least(F.greatest(size, F.lit(1.0)), F.lit(1e6)).alias("k")).alias(k)

    hosts = hosts.withColumn("prior", sums.select(F.struct(*map(prior, failed))).scalar())
    rates = {k: (v + F.col(f"prior.{k}.m") * F.col(f"prior.{k}.k")) / (n + F.col(f"prior.{k}.k")) for k, v in f.items()}
    hosts = hosts.withColumns({f"host_rate_{k}": r for k, r in rates.items()}).drop("prior")
    return hosts.withColumn("host_rate", F.greatest(*(F.col(f"host_rate_{k}") for k in failed)) if len(failed) > 1 else F.col(f"host_rate_{next(iter(failed))}")).withColumn("host_rejected", F.col("host_rate") > max_rate)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """One row per document: its id, the measures, base_failed, its host's figures and kept.

    kept is false if the document fails the base rule or its host is rejected.
    Null ids and hosts are kept as they are (a null host is a host), rows with
    equal ids are judged each on their own, and a null or empty text fails the
    base rule.  An empty table gives no rows; other columns of docs, whatever
    their names, take no part.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    measured = with_measures(slim).drop("text").withColumns({f"failed_{k}": c for k, c in rules().items()})
    measured = scratch.table(measured, "quality")
    hosts = host_verdicts(measured, "host", {k: f"failed_{k}" for k in RULES}, max_rate)
    d, h = measured.alias("d"), hosts.alias("h")
    joined = d.join(h, F.col("d.host").eqNullSafe(F.col("h.host")), "left")
    figures = [c for c in hosts.columns if c != "host"]
    return joined.select("d.doc_id", *MEASURES, F.col("failed_base").alias("base_failed"), F.col("d.host").alias("host"), *figures, (~F.col("failed_base") & ~F.col("host_rejected")).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows of docs, with docs' columns, that pass the base rule and whose host is not rejected.

    Null and empty texts fail; a null host is a host; repeated rows are judged
    and kept each on their own; texts are measured whole, once.  An empty table
    gives no rows, and columns may have any names.
    """
    p = scratch.unused(docs, "_quarry_q_")
    bits = {f"{p}failed_{k}": c for k, c in rules(p).items()}
    measured = with_measures(docs, text_col, p).withColumns(bits).drop(*(p + k for k in MEASURES))
    # Texts that fail are not written; their rows are, for the hosts' figures.
    measured = scratch.table(measured.withColumn(text_col, F.when(~F.col(f"{p}failed_base"), F.col(text_col))), "quality")
    hosts = host_verdicts(measured, host_col, {k: f"{p}failed_{k}" for k in RULES}, max_rate)
    bad = scratch.table(hosts.where("host_rejected").select(F.col("host").alias(p + "host")), "quality-bad")
    passed = measured.where(~F.col(f"{p}failed_base"))
    return passed.join(bad, passed[host_col].eqNullSafe(bad[p + "host"]), "left_anti").select(*docs.columns)
