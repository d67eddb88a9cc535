"""Quality classification by co-training two views of a document.

One classifier sees the text's content (character pairs and how words repeat), the
other its page metadata (source, language, recorded length, and layout: lines,
letter case, digits, symbols, white space). Both are fitted on a bounded sample of
labelled rows. Then, for some rounds, each labels the rows of an unlabelled pool
that it is confident about, in the proportion of the classes, for the other view
to learn from. Last, each view is calibrated on labelled rows that neither has
learned from, and the calibrated log-odds, independent given the class, add up.

Fitting happens on at most ``max_labelled + max_pool`` rows, taken in the order of
a hash of their ids; every document is scored, in one pass that does not shuffle.

Null texts are empty, null metadata is a value of its own; ids may be null (such
rows are scored, not learned from) or repeat (a repeated label counts as its mean).
Without labels of both classes, nothing can be learned: every score is 1 and
everything is kept. Equal rows get equal scores, an empty table an empty result;
columns other than the named ones are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailassay.llm.common import documents, text_bytes, words_of


@dataclass(frozen=True)
class CoTrainingPolicy:
    #: bounds of the rows that the driver fits on
    max_labelled: int = 6000
    max_pool: int = 6000
    rounds: int = 3
    #: a view labels rows for the other only with this probability or more
    confidence: float = 0.95
    #: at most this share of the pool moves per round and view
    share_per_round: float = 0.2
    steps: int = 120
    ridge: float = 1e-3
    keep_from: float = 0.5


PAIR_BINS, NAME_BINS = 512, 48
_BLOCK = 1024  # rows of a product at once
_PAIR_CODES = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)).astype(np.int64)
_SYMBOLS = b"#*$%&|<>{}[]\\^~=_@"


def content_features(text: bytes) -> np.ndarray:
    """Root frequencies of character pairs, and four measures of repetition."""
    out = np.zeros(PAIR_BINS + 4, np.float32)
    if len(text) > 1:
        data = np.frombuffer(text, np.uint8).astype(np.int64)
        counts = np.bincount(_PAIR_CODES[data[:-1] * 256 + data[1:]], minlength=PAIR_BINS)
        out[:PAIR_BINS] = np.sqrt(counts / (len(text) - 1))
    words = words_of(text)
    if words:
        n = len(words)
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        out[PAIR_BINS] = len(number) / np.sqrt(n)
        out[PAIR_BINS + 1] = np.count_nonzero(ids[1:] == ids[:-1]) / n
        out[PAIR_BINS + 2] = np.bincount(ids).max() / n if n > 20 else 0.0
        out[PAIR_BINS + 3] = sum(map(len, words)) / n / 10
    return out


def metadata_features(text: bytes, source, lang, recorded) -> np.ndarray:
    """Hashed source and language, recorded length, and layout measures."""
    out = np.zeros(NAME_BINS + 12, np.float32)
    for kind, value in (("s", source), ("l", lang)):
        out[zlib.crc32(f"{kind}:{value}".encode("utf-8", "replace")) % NAME_BINS] = 1
    size = max(1, len(text))
    lines = text.split(b"\n")
    longest = max(map(len, lines))
    share = lambda kind: (len(text) - len(text.translate(None, kind))) / size
    out[NAME_BINS:] = (
        np.log1p(max(0, recorded)) if recorded is not None and recorded == recorded else -1,
        np.log1p(len(text)),
        np.log1p(len(lines)),
        np.log1p(longest),
        len(set(lines)) / len(lines),
        share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        share(b"0123456789"),
        share(_SYMBOLS),
        share(b" \t\r\n"),
        share(b"!?"),
        share(b".,;:"),
        share(bytes(range(128, 256))),
    )
    return out


def view_features(text, source, lang, recorded) -> tuple[np.ndarray, np.ndarray]:
    text = bytes(text) if text is not None else b""
    return content_features(text), metadata_features(text, source, lang, recorded)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class View:
    """Logistic regression on scaled features, with a calibration of its log-odds."""

    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    slope: float = 1.0
    offset: float = 0.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        z = np.ones((x.shape[0], x.shape[1] + 1), x.dtype)  # filled in place: one copy of the rows is enough
        inner = z[:, :-1]
        np.subtract(x, self.mean, out=inner)
        np.divide(inner, self.scale, out=inner)
        np.clip(inner, -6, 6, out=inner)
        return z

    def fit(self, x: np.ndarray, y: np.ndarray, policy: CoTrainingPolicy) -> View:
        self.mean = x.mean(axis=0)
        self.scale = x.std(axis=0) + 1e-3
        z = self.scaled(x)
        self.weights = accelerated_logistic(z, y, policy.steps, policy.ridge)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weights

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Slope and offset of the log-odds by regression on rows not learned from."""
        raw = self.raw(x)
        # soft targets keep the slope finite where the classes separate
        positives, n = y.sum(), len(y)
        target = np.where(y == 1, (positives + 1) / (positives + 2), 1 / (n - positives + 2))
        z = np.stack([raw, np.ones(n)], axis=1)
        w = np.array([1.0, 0.0])
        for _ in range(30):
            p = sigmoid(z @ w)
            hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
            step = np.linalg.solve(hessian, z.T @ (target - p) - 1e-3 * (w - [1, 0]))
            w = w + np.clip(step, -2, 2)
        self.slope, self.offset = float(max(0.0, w[0])), float(w[1])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.offset


def accelerated_logistic(z: np.ndarray, y: np.ndarray, steps: int, ridge: float) -> np.ndarray:
    """Weights by accelerated gradient steps of the safe length."""
    n, d = z.shape
    v = np.ones(d, z.dtype) / np.sqrt(d)
    for _ in range(8):
        v = z.T @ (z @ v)
        norm = float(np.linalg.norm(v)) or 1.0
        v = v / norm
    rate = 1 / (1.1 * norm / (4 * n) + ridge)
    w = ahead = np.zeros(d, np.float64)
    for step in range(steps):
        gradient = np.zeros(d, np.float64)
        for start in range(0, n, _BLOCK):  # a product with doubles copies its rows as doubles
            part = z[start : start + _BLOCK].astype(np.float64)
            gradient += part.T @ (sigmoid(part @ ahead) - y[start : start + _BLOCK])
        gradient = gradient / n + ridge * ahead
        after = ahead - rate * gradient
        ahead = after + step / (step + 3) * (after - w)
        w = after
    return w


@dataclass
class CoTrained:
    views: list[View] = field(default_factory=list)
    prior: float = 0.0

    def scores(self, features: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of good quality by each view and by both."""
        odds = [view.log_odds(x) for view, x in zip(self.views, features)]
        return [sigmoid(o) for o in odds] + [sigmoid(odds[0] + odds[1] - self.prior)]


def co_train(
    features: list[np.ndarray], labels: np.ndarray, pool: list[np.ndarray], policy: CoTrainingPolicy
) -> CoTrained | None:
    """Fit, exchange pseudo-labels, calibrate. Every fourth labelled row is kept for calibration."""
    held = np.arange(len(labels)) % 4 == 3
    if len(set(labels[~held])) < 2 or len(set(labels[held])) < 2:
        return None
    positive = float(labels[~held].mean())
    taught = [[(x[~held], labels[~held])] for x in features]
    free = [np.ones(len(pool[0]), bool) for _ in features]
    views: list[View] = []
    for turn in range(policy.rounds + 1):
        views = [
            View().fit(np.concatenate([x for x, _ in part]), np.concatenate([y for _, y in part]), policy)
            for part in taught
        ]
        if turn == policy.rounds or not len(pool[0]):
            break
        for teacher, pupil in ((0, 1), (1, 0)):
            p = sigmoid(views[teacher].raw(pool[teacher]))
            room = policy.share_per_round * len(p)
            for label, sure, quota in ((1.0, p, room * positive), (0.0, 1 - p, room * (1 - positive))):
                order = np.argsort(-sure, kind="stable")
                chosen = [i for i in order if sure[i] >= policy.confidence and free[pupil][i]][: int(np.ceil(quota))]
                if chosen:
                    free[pupil][chosen] = False
                    taught[pupil].append((pool[pupil][chosen], np.full(len(chosen), label)))
    for view, x in zip(views, features):
        view.calibrate(x[held], labels[held])
    return CoTrained(views, float(np.log(positive / (1 - positive))))


def _columns(docs: DataFrame) -> list[Column]:
    """Text, source, language and recorded length; what a table lacks is null."""
    have = set(docs.columns)
    pick = lambda c, t: F.col(f"`{c}`").cast(t) if c in have else F.lit(None).cast(t)
    return [text_bytes("text"), pick("source", "string"), pick("lang", "string"), pick("n_chars", "double")]


def _features_of(text: pd.Series, source: pd.Series, lang: pd.Series, recorded: pd.Series) -> list[np.ndarray]:
    both = [view_features(*row) for row in zip(text, source, lang, recorded)]
    sizes = (PAIR_BINS + 4, NAME_BINS + 12)
    return [np.array([b[i] for b in both], np.float32).reshape(-1, sizes[i]) for i in (0, 1)]


def sample_features(docs: DataFrame, ids: DataFrame) -> pd.DataFrame:
    """Features and label (null in the pool) of the rows named by ``ids``, a bounded table."""

    @F.pandas_udf("binary")
    def encode(text: pd.Series, source: pd.Series, lang: pd.Series, recorded: pd.Series) -> pd.Series:
        joined = np.hstack(_features_of(text, source, lang, recorded))
        return pd.Series([row.tobytes() for row in joined])

    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(c.alias(n) for c, n in zip(_columns(docs), "tslr")))
    chosen = named.join(F.broadcast(ids), "doc_id")
    rows = chosen.select("doc_id", "label", encode("t", "s", "l", "r").alias("features"))
    # of rows that share an id, one is enough, and the same one each time
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("label", "features")).alias("r"))
    return rows.select("doc_id", "r.label", "r.features").toPandas().sort_values("doc_id")


def chosen_ids(docs: DataFrame, labels: DataFrame, policy: CoTrainingPolicy) -> DataFrame:
    """At most ``max_labelled`` labelled and ``max_pool`` unlabelled ids, in hash order."""
    order = F.xxhash64("doc_id", F.lit("co-training"))
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    )
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    labelled = known.join(ids, "doc_id", "left_semi").orderBy(order, "doc_id").limit(policy.max_labelled)
    pool = ids.join(known, "doc_id", "left_anti").orderBy(order, "doc_id").limit(policy.max_pool)
    return labelled.union(pool.select("doc_id", F.lit(None).cast("double").alias("label")))


def train(docs: DataFrame, labels: DataFrame, policy: CoTrainingPolicy = CoTrainingPolicy()) -> CoTrained | None:
    sample = sample_features(docs, chosen_ids(docs, labels, policy))
    width = PAIR_BINS + 4
    x = np.array([np.frombuffer(b, np.float32) for b in sample["features"]], np.float32).reshape(-1, width + NAME_BINS + 12)
    y = sample["label"].to_numpy(np.float64)
    del sample
    known = ~np.isnan(y)
    views = lambda rows: [x[rows, :width], x[rows, width:]]
    labelled, pool = views(known), views(~known)
    del x
    return co_train(labelled, y[known], pool, policy)


def quality(docs: DataFrame, model: CoTrained | None) -> Column:
    """A struct (p_text, p_metadata, score) for each row, computed where the row is."""
    kind = "p_text double, p_metadata double, score double"
    if model is None:
        return F.struct(*(F.lit(1.0).alias(n) for n in ("p_text", "p_metadata", "score")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(kind)
    def rate(text: pd.Series, source: pd.Series, lang: pd.Series, recorded: pd.Series) -> pd.DataFrame:
        scores = shared.value.scores(_features_of(text, source, lang, recorded))
        return pd.DataFrame(dict(zip(("p_text", "p_metadata", "score"), (s.astype(np.float64) for s in scores))))

    return rate(*_columns(docs))


def keep_good(docs: DataFrame, labels: DataFrame, policy: CoTrainingPolicy = CoTrainingPolicy()) -> DataFrame:
    """The rows of ``docs`` that both views together find good."""
    return docs.filter(quality(docs, train(docs, labels, policy)).getField("score") >= policy.keep_from)


def op5_co_training(spark, sf_dir) -> DataFrame:
    docs, policy = documents(spark, sf_dir), CoTrainingPolicy()
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), policy)
    rated = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), quality(docs, model).alias("q"))
    return rated.select("doc_id", "q.p_text", "q.p_metadata", "q.score", (F.col("q.score") >= policy.keep_from).alias("kept"))
