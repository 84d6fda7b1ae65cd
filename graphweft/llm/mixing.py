"""Mixing sources to target weights by soft membership.

A classifier fitted on the documents of target sources (multinomial naive Bayes over hashed tokens, its evidence
tempered on documents held out) gives every other document a posterior over the target sources; labelled documents
belong to their source wholly. Projected gradient least squares then fits a rate for every document, between 0 and
its cap, so that the expected tokens of each source meet its target. Documents of equal membership have equal
gradients and so equal rates; posteriors are rounded to quarters for that, and Spark adds up the expected tokens of
each such bin exactly, so that the passes run over bins, however many documents there are. Rates become whole
repeats by a threshold in a hash order within classes of size, from bounded histograms; what a class cannot meet
goes on to the next smaller one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.llm.tokens import TOKENIZER, encoding
from graphweft.session import written

#: Token ids are hashed into as many features.
FEATURES = 4096
SMOOTHING = 0.5
#: Labelled documents held out (about) to temper the evidence, and their share at most.
HELD_OUT, HELD_SHARE = 2000, 0.125
#: Posteriors are rounded to as many parts; D sources then have at most C(D + PARTS - 1, PARTS) bins, 7,315 for 19.
PARTS = 4
#: Passes of the least squares at most, and the change of the totals (as a share of the goal) that ends them.
PASSES, TOLERANCE = 500, 1e-6
#: Buckets of the hash order in each source and class of size.
BUCKETS = 1024
ORDER = 1 << 40


def source_key(column: str):
    """A source's name without blanks around it, in lower case; blank is null."""
    return F.nullif(F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")), F.lit(""))


def _packed(counts: np.ndarray) -> list[int]:
    """The features that occur, each as one number: the feature above 32 bits of its count."""
    f = np.flatnonzero(counts)
    return ((f << 32) | counts[f]).tolist()


def _measured(docs: DataFrame, id_col: str, source_col: str, text_col: str, names: list[str], held: float, tokenizer: str) -> DataFrame:
    """One pass over the texts: sizes of all documents, feature sums per source, features of the other documents.

    Features also have the labelled documents that are held out; the sums are without those.
    """
    with open(tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    known = {name: k for k, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks.value).encode_ordinary
        sums = np.zeros((len(names), FEATURES), dtype=np.int64)
        columns = ["id", "source", "held", "n_tokens", "features", "is_sum"]
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            sizes, features = [], []
            per_source: dict[int, list] = {}
            for source, apart, text in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                ids = encode(text)
                sizes.append(len(ids))
                if apart or source not in known:
                    features.append(_packed(np.bincount(np.array(ids, dtype=np.int64) % FEATURES)))
                else:
                    features.append(None)
                    per_source.setdefault(known[source], []).append(ids)
            for k, lists in per_source.items():
                sums[k] += np.bincount(np.fromiter(chain.from_iterable(lists), np.int64) % FEATURES, minlength=FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int32()), pa.array(features, pa.list_(pa.int64())), pa.array([False] * len(sizes), pa.bool_())], columns)
        if kind is not None:
            at = [k for k in range(len(names)) if sums[k].any()]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), kind), pa.array([names[k] for k in at], pa.string()), pa.array([False] * len(at), pa.bool_()), pa.array([0] * len(at), pa.int32()), pa.array([_packed(sums[k]) for k in at], pa.list_(pa.int64())), pa.array([True] * len(at), pa.bool_())], columns)

    source = source_key(source_col)
    apart = F.coalesce(source.isin(names), F.lit(False)) & (F.pmod(F.xxhash64(F.lit("held"), F.col(id_col)), F.lit(ORDER)) < int(held * ORDER))
    rows = docs.where(F.trim(F.regexp_replace(text_col, r"\s+", " ")) != "").select(F.col(id_col).alias("id"), source.alias("source"), apart.alias("held"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, source string, held boolean, n_tokens int, features array<long>, is_sum boolean")


def log_likelihoods(sums: np.ndarray) -> np.ndarray:
    """Smoothed log likelihoods of the features of each source (rows)."""
    smooth = sums + SMOOTHING
    return np.log(smooth / smooth.sum(axis=1, keepdims=True))


@dataclass
class Classifier:
    """Likelihoods (sources x features) and priors; a text of n tokens counts as ``scale * n ** power`` of them."""

    likelihood: np.ndarray
    prior: np.ndarray
    scale: float = 1.0
    power: float = 1.0

    def scores(self, packed: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log likelihoods per token of each document under each source, and the numbers of tokens."""
        flat = np.fromiter(chain.from_iterable(packed), np.int64)
        size = np.array([len(p) for p in packed], dtype=np.int64)
        count = (flat & 0xFFFFFFFF).astype(float)
        at = np.repeat(np.arange(len(packed)), size)
        n = np.bincount(at, weights=count, minlength=len(packed))
        by_feature = self.likelihood.T
        out = np.stack([np.bincount(at, weights=count * by_feature[flat >> 32, k], minlength=len(packed)) for k in range(len(self.prior))], axis=1) if len(packed) else np.zeros((0, len(self.prior)))
        return out / np.maximum(n, 1)[:, None], n

    def posteriors(self, packed: list[list[int]]) -> np.ndarray:
        """Posterior of each document over the sources; sources without documents get nothing."""
        return self._from(*self.scores(packed))

    def _from(self, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            score = mean * (self.scale * n**self.power)[:, None] + np.log(self.prior)
        score -= score.max(axis=1, keepdims=True, initial=-np.inf) if len(score) else 0
        p = np.exp(score)
        return p / p.sum(axis=1, keepdims=True)

    def tempered(self, packed: list[list[int]], truth: np.ndarray) -> tuple[Classifier, dict[str, float]]:
        """With the scale and power that make the held-out labels likeliest, and how good it is on them.

        ``accuracy``, ``log_loss`` and ``calibration_error`` (mean gap of confidence and accuracy in tenths).
        """
        if not len(packed):
            return Classifier(self.likelihood, self.prior, 1.0, 0.0), {}
        mean, n = self.scores(packed)
        rows = np.arange(len(truth))
        best = None
        for power in (0.0, 0.25, 0.5, 0.75, 1.0):
            for scale in 2.0 ** np.arange(-4, 11):
                fit = Classifier(self.likelihood, self.prior, float(scale), power)
                p = fit._from(mean, n)
                loss = float(-np.log(np.maximum(p[rows, truth], 1e-300)).mean())
                if best is None or loss < best[0]:
                    best = (loss, fit, p)
        loss, fit, p = best
        sure, right = p.max(axis=1), p.argmax(axis=1) == truth
        tenth = np.minimum((sure * 10).astype(int), 9)
        gap = sum(abs(sure[tenth == k].sum() - right[tenth == k].sum()) for k in range(10)) / len(truth)
        return fit, {"accuracy": float(right.mean()), "log_loss": loss, "calibration_error": float(gap)}


def fitted_rates(tokens: np.ndarray, cap: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Rates within [0, cap] of groups whose expected ``tokens`` (groups x sources) shall add up to ``goal``.

    Least squares of what is missed, by projected gradient; each group's step is relative to its own tokens, and
    all are relative to the most that a source has, which keeps the steps from growing.
    """
    most, own = max(float(tokens.sum(axis=0).max(initial=0.0)), 1.0), np.maximum(tokens.sum(axis=1), 1e-9)
    share = tokens / own[:, None]
    rate = np.zeros(len(cap))
    total = rate @ tokens
    for _ in range(PASSES):
        rate = np.clip(rate - share @ (total - goal) / most, 0.0, cap)
        before, total = total, rate @ tokens
        if np.abs(total - before).max(initial=0.0) <= TOLERANCE * max(np.abs(goal).sum(), 1.0):
            break
    return rate


def distance(tokens: np.ndarray, share: np.ndarray) -> float:
    """Half the sum of the differences between the shares of ``tokens`` and ``share``."""
    return float(np.abs(tokens / max(tokens.sum(), 1e-9) - share / max(share.sum(), 1e-9)).sum() / 2)


def partial_edges(histogram: dict[int, dict[int, int]], fraction: float) -> dict[int, int]:
    """For each class of size the bucket before which documents are taken, so that ``fraction`` of all is met.

    ``histogram`` has the tokens of each class and bucket. Larger classes come first and never take too much; what
    they leave is taken from the smaller ones, so that what is missed is half a bucket of the smallest class.
    """
    edges, carry = {}, 0.0
    classes = sorted(histogram, reverse=True)
    for k in classes:
        need, taken, edge = fraction * sum(histogram[k].values()) + carry, 0, BUCKETS
        for bucket in sorted(histogram[k]):
            n = histogram[k][bucket]
            if taken + (n / 2 if k == classes[-1] else n) > need + 1e-6:
                edge = bucket
                break
            taken += n
        edges[k] = edge
        carry = need - taken
    return edges


def mix(docs: DataFrame, targets: DataFrame, *, id_col: str, source_col: str, text_col: str, target_source_col: str = "source", share_col: str = "target_share", repeats_col: str = "max_repeats", total_tokens: int | None = None, least_total: float = 0.5, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """Choose and repeat documents so that each source reaches its share: (chosen documents, shares).

    Chosen: ``id, source, membership, n_tokens, repeats`` with repeats of 1 and more. ``membership`` is
    ``labelled`` for documents of a target source (used ``max_repeats`` times at most) and ``soft`` for all others,
    without a source or of one without a target (used once at most, where their expected sources lack tokens).
    Shares, one row per target: ``source, target_share, max_repeats, n_docs, available_tokens, goal_tokens,
    labelled_tokens, soft_tokens, labelled_share, reached_share, distance_before, distance_after``; the shares are of
    all chosen tokens, without and with the expected part of the soft documents. The distances are half the sum of
    the differences from the target shares, for all labelled documents once and for the chosen ones.

    The goal is ``total_tokens``, or else what of all tokens of the target sources (from ``least_total`` of them to
    all) comes nearest to the target shares: where sources are short, less of the others is used. A source that its
    cap keeps from its goal stays short, with all its documents at the cap; a target without documents cannot be
    told by the classifier and stays empty. Names compare without blanks around them and in any case. Null and
    blank texts and null ids are not used. Shares and caps must not be negative; null ones count as 0. Repeated
    targets: the largest share and the smallest cap count.

    ``targets`` is a table of settings (a few rows), gathered on the driver as are the classifier (sources x
    FEATURES numbers), the held-out documents, the bins and the histograms (sources x classes x BUCKETS).
    """
    spark = docs.sparkSession
    wanted = targets.select(source_key(target_source_col).alias("source"), F.coalesce(F.col(share_col).cast("double"), F.lit(0.0)).alias("share"), F.coalesce(F.col(repeats_col).cast("int"), F.lit(0)).alias("cap"))
    goals = {r["source"]: (r["share"], r["cap"]) for r in wanted.where("source is not null").groupBy("source").agg(F.max("share").alias("share"), F.min("cap").alias("cap")).orderBy("source").collect()}
    names = list(goals)
    share, cap = (np.array([goals[n][k] for n in names], dtype=float) for k in (0, 1))

    usable = docs.where(F.col(id_col).isNotNull())
    labelled_docs = usable.where(source_key(source_col).isin(names)).count()
    measured = written(_measured(usable, id_col, source_col, text_col, names, min(HELD_SHARE, HELD_OUT / max(labelled_docs, 1)), tokenizer))
    sized = measured.where("not is_sum")
    labelled = sized.where(F.col("source").isin(names))
    place = F.pmod(F.xxhash64("id"), F.lit(ORDER))
    labelled = labelled.select("id", "source", "n_tokens", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int").alias("class"), (place / F.lit(ORDER // BUCKETS)).cast("int").alias("bucket"))
    histogram: dict[str, dict[int, dict[int, int]]] = {n: {} for n in names}
    n_docs = dict.fromkeys(names, 0)
    for r in labelled.groupBy("source", "class", "bucket").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).toLocalIterator():
        histogram[r["source"]].setdefault(r["class"], {})[r["bucket"]] = r["n"]
        n_docs[r["source"]] += r["docs"]
    own = np.array([sum(sum(b.values()) for b in histogram[n].values()) for n in names], dtype=float)

    # the classifier: feature sums per source, added up over the tasks; its evidence from the documents held out
    sums = np.zeros((len(names), FEATURES))
    for r in measured.where("is_sum").select("source", F.explode("features").alias("x")).groupBy("source", F.shiftright("x", 32).alias("f")).agg(F.sum(F.col("x").bitwiseAND((1 << 32) - 1)).alias("n")).toLocalIterator():
        sums[names.index(r["source"]), r["f"]] = r["n"]
    held = sized.where("held").select("source", "features").collect()
    prior = sums.sum(axis=1) / max(sums.sum(), 1.0)
    fit, _ = Classifier(log_likelihoods(sums), prior).tempered([r["features"] for r in held], np.array([names.index(r["source"]) for r in held], dtype=int))
    model = spark.sparkContext.broadcast(fit)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.posteriors(batch.column(3).to_pylist())
            bins = np.rint(p * PARTS).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(p), pa.list_(pa.float64())), pa.array([b.tobytes().hex() for b in bins], pa.string())], ["id", "source", "n_tokens", "member", "bin"])

    kind = measured.schema["id"].dataType.simpleString()
    other = sized.where(~F.coalesce(F.col("source").isin(names), F.lit(False)) & F.lit(bool(sums.any()))).select("id", "source", "n_tokens", "features")
    soft = written(other.mapInArrow(judge, f"id {kind}, source string, n_tokens int, member array<double>, bin string"))

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Expected tokens of each source in each bin."""
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            member = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, len(names)) * batch.column(0).to_numpy()[:, None]
            for b, row in zip(batch.column(2).to_pylist(), member, strict=True):
                sums[b] = sums[b] + row if b in sums else row
        rows = [(b, d, float(x)) for b, row in sums.items() for d, x in enumerate(row) if x]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.float64()))], ["bin", "d", "tokens"])

    def per_bin(rows: DataFrame) -> DataFrame:
        return rows.select("n_tokens", "member", "bin").mapInArrow(expected, "bin string, d int, tokens double").groupBy("bin", "d").agg(F.sum("tokens").alias("tokens"))

    held_by_bin: dict[str, np.ndarray] = {}
    for r in per_bin(soft).orderBy("bin", "d").collect():
        held_by_bin.setdefault(r["bin"], np.zeros(len(names)))[r["d"]] = r["tokens"]
    bins = list(held_by_bin)

    # documents of a source share their membership and cap; the other documents only fill what those leave open
    tokens = np.array([held_by_bin[b] for b in bins]).reshape(len(bins), len(names))
    best = None
    for total in [float(total_tokens)] if total_tokens is not None else float(own.sum()) * np.arange(1.0, least_total - 1e-9, -0.1):
        goal = share * total
        rate = fitted_rates(np.diag(own), cap, goal)
        filled = own * rate
        fill = fitted_rates(tokens, np.ones(len(bins)), goal - filled)
        away = distance(filled + fill @ tokens, share)
        if best is None or away < best[0] - 1e-4:
            best = (away, goal, rate, fill)
    _, goal, rate, fill = best
    whole = np.floor(rate + 1e-9)

    # whole repeats: all documents of a source by the whole part, and of each class the first ones in hash order by the rest
    settings = [(n, k, int(whole[d]), edge) for d, n in enumerate(names) for k, edge in partial_edges(histogram[n], float(max(rate[d] - whole[d], 0.0))).items()]
    setting = spark.createDataFrame(settings or [("", 0, 0, 0)], "source string, class int, whole int, edge int")
    taken = labelled.join(F.broadcast(setting), ["source", "class"]).withColumn("repeats", F.col("whole") + (F.col("bucket") < F.col("edge")).cast("int")).where("repeats > 0").select("id", "source", "n_tokens", "repeats")

    rates = spark.createDataFrame([(b, float(fill[k])) for k, b in enumerate(bins)] or [("", 0.0)], "bin string, rate double")
    picked = soft.join(F.broadcast(rates), "bin").where(place / F.lit(float(ORDER)) < F.col("rate"))
    chosen = taken.select("id", "source", F.lit("labelled").alias("membership"), "n_tokens", "repeats").unionByName(picked.select("id", "source", F.lit("soft").alias("membership"), "n_tokens", F.lit(1).alias("repeats")))

    table = spark.createDataFrame([(n, k, float(share[k]), int(cap[k]), n_docs[n], int(own[k]), round(float(goal[k]))) for k, n in enumerate(names)] or [("", 0, 0.0, 0, 0, 0, 0)], "source string, d int, target_share double, max_repeats int, n_docs long, available_tokens long, goal_tokens long").where("source <> ''")
    hard = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("labelled_tokens"))
    given = per_bin(picked).groupBy("d").agg(F.sum("tokens").alias("soft_tokens"))
    shares = table.join(hard, "source", "left").join(given, "d", "left").na.fill(0, ["labelled_tokens", "soft_tokens"])
    every = Window.partitionBy()  # one row per target
    total = F.greatest(F.sum(F.col("labelled_tokens") + F.col("soft_tokens")).over(every), F.lit(1.0))
    reached = (F.col("labelled_tokens") + F.col("soft_tokens")) / total
    wanted_share = F.col("target_share") / F.lit(max(float(share.sum()), 1e-9))
    return chosen, shares.withColumn("reached", reached).select(
        "source", "target_share", "max_repeats", "n_docs", "available_tokens", "goal_tokens", "labelled_tokens", F.round("soft_tokens", 3).alias("soft_tokens"),
        F.round(F.col("labelled_tokens") / total, 6).alias("labelled_share"), F.round("reached", 6).alias("reached_share"),
        F.lit(round(distance(own, share), 6)).alias("distance_before"), F.round(F.sum(F.abs(F.col("reached") - wanted_share)).over(every) / 2, 6).alias("distance_after"),
    )
