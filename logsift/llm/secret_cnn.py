"""Secret scan: fixed rules plus a character convolutional network.

``rule_spans`` finds the three fixed kinds in a whole text. Besides, every run
of 16 or more token characters with a letter and a digit is a candidate. A
small convolutional network in numpy looks at the characters of the candidate
and of the context around it and gives a probability; candidates above the
threshold become spans of kind ``model`` unless they overlap a rule's span.

The network has one-hot characters, one convolution, maximum pooling apart over
the candidate and over its context, and a logistic layer; pooling makes it work
on candidates of any length. It is trained on labelled findings:

* positives are rule findings of the corpus and variants of them: the same
  value without its keyword, and values drawn from the alphabets and prefixes
  secrets use, with and without a keyword;
* negatives are candidates no rule fits, and identifiers, paths and dates put
  together from the corpus's own words.

All texts are searched for findings, and every distinct one takes part: half of
them train, half calibrate. By their hash they are dealt into shards of about
``SHARD``, each with variants made of its own findings. An epoch is a Spark job
in which every shard trains on from the same network; the results are averaged
by the shards' number of items. Calibration scales the probabilities (Platt, by
Newton steps over all items), and the threshold is the highest that keeps a
recall of ``RECALL`` on all calibration positives, however low that is.
Values beyond 4,096 characters are scanned but not trained on.

Defined results: a null text is empty and has no spans; repeated rows are scanned
alike; with no findings to train on, only rules apply; an empty table gives no
rows; ids of any kind and further columns are passed through where asked for.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.session import cut_lineage, forget

from .common import share, shared
from .words import text_slices

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
LEAST = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
LONGEST = 4096  # characters of a finding that is trained on; longer ones are scanned like all others
BEFORE, AFTER, WIDTH, FILTERS = 20, 8, 5, 32
SHARD, VARIANTS, RECALL, EPOCHS = 1 << 14, 1000, 0.98, 12  # VARIANTS: of each label in a shard's half, at least
UNIT, STEPS = 2.0**50, 8000  # averaged states are summed as whole numbers of 1 / UNIT, so the order of tasks changes nothing; steps are counted so far

Span = tuple[str, int, int, int, int]  # kind, start, end, start and end of the secret itself


def rule_spans(text: str) -> list[Span]:
    """Spans of the fixed kinds by start, then kind as listed; code points, end exclusive."""
    out: list[Span] = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [("assign", *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span(), *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span(), *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, begin: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Runs between two places that may be secrets: a letter and a digit in 16 or more token characters."""
    end = len(text) if end is None else end
    return [m.span() for m in RUN.finditer(text, begin, end) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]


def open_runs(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Candidates outside the rule spans: a run that a span touches is cut there, and what is
    left of it is judged on its own. One sweep over runs and spans, both in order of their start."""
    out, k = [], 0
    for m in RUN.finditer(text):
        at, end = m.span()
        while k < len(spans) and spans[k][1] < end:
            _, a, b, _, _ = spans[k]
            if a - at >= LEAST:
                out += candidates(text, at, a)
            at = max(at, b)
            if b > end:
                break  # it may reach into the next run
            k += 1
        if end - at >= LEAST:
            out += candidates(text, at, end)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


class Windows:
    """Characters of candidates and contexts in one array, and where each begins."""

    def __init__(self, items: list[tuple[str, int, int]]):
        parts, self.core = [], []
        pad = "\0" * (WIDTH - 1)
        at = 0
        for text, a, b in items:
            left, right = text[max(0, a - BEFORE):a], text[b:b + AFTER]
            # candidate, gap, context on both sides, gap: no filter spans a gap's both sides unseen
            part = pad + text[a:b] + pad + left + "\1" + right + pad
            self.core.append((at, at + len(pad) + b - a))
            at += len(part)
            parts.append(part)
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.codes = np.append(np.where(codes < 128, codes, 127).astype(np.int64), np.zeros(WIDTH, np.int64))
        # Two pools an item: from its start, and from the end of the candidate.
        self.begin = np.array(self.core, np.int64).reshape(-1)


PARAMS = ("tables", "bias", "out", "out_bias")


class Network:
    """One-hot convolution (tables per offset), two maximum pools, logistic layer."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.tables = r.normal(0, 0.3, (WIDTH, 128, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = r.normal(0, 0.3, 2 * FILTERS)
        self.out_bias = 0.0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.1  # nothing passes before calibration
        self.moments: np.ndarray | None = None  # while it is trained: Adam's, and the number of steps

    def state(self) -> np.ndarray:
        own = np.concatenate([np.ravel(getattr(self, p)) for p in PARAMS])
        return np.append(own, np.zeros(2 * len(own) + 1) if self.moments is None else self.moments)

    def load(self, state: np.ndarray) -> None:
        at = 0
        for p in PARAMS:
            old = np.asarray(getattr(self, p))
            new = state[at:at + old.size].reshape(old.shape)
            setattr(self, p, new.copy() if old.ndim else float(new))
            at += old.size
        self.moments = state[at:].copy()

    def _pooled(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        n = len(w.codes) - WIDTH
        z = np.tile(self.bias, (n, 1))
        for k in range(WIDTH):
            z += self.tables[k][w.codes[k:k + n]]
        return z, np.maximum.reduceat(z, w.begin, axis=0)

    def logits(self, w: Windows) -> np.ndarray:
        pooled = np.maximum(self._pooled(w)[1], 0).reshape(len(w.core), 2 * FILTERS)
        return pooled @ self.out + self.out_bias

    def probabilities(self, items: list[tuple[str, int, int]]) -> np.ndarray:
        """Calibrated probabilities, a bounded number of characters at a time."""
        out, some, size = [], [], 0
        for it in items:
            some.append(it)
            size += it[2] - it[1] + BEFORE + AFTER
            if size > 1 << 18:
                out.append(self.logits(Windows(some)))
                some, size = [], 0
        if some:
            out.append(self.logits(Windows(some)))
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -60, 60)))

    def epoch(self, items: list[tuple[str, int, int]], label: np.ndarray, seed: int) -> None:
        """Adam on the logistic loss, once over the items; the gradient of a maximum goes to its place."""
        order = np.random.default_rng(seed).permutation(len(items))
        n = len(self.state()) // 3
        m, v, step = ((np.zeros(n), np.zeros(n), 0.0) if self.moments is None
                      else (self.moments[:n].copy(), self.moments[n:2 * n].copy(), self.moments[-1]))
        for begin in range(0, len(items), 128):
            pick = order[begin:begin + 128]
            w = Windows([items[i] for i in pick])
            z, top = self._pooled(w)
            pooled = np.maximum(top, 0).reshape(len(pick), 2 * FILTERS)
            p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.out_bias, -60, 60)))
            d = (p - label[pick]) / len(pick)
            back = (d[:, None] * self.out[None, :]).reshape(-1, FILTERS) * (top > 0)
            # first place of each pool's maximum
            pool = np.repeat(np.arange(len(w.begin)), np.diff(np.append(w.begin, len(z))))
            where = np.where(z == top[pool], np.arange(len(z))[:, None], len(z))
            place = np.minimum.reduceat(where, w.begin, axis=0)
            g = {"out": pooled.T @ d, "out_bias": d.sum(), "bias": back.sum(axis=0), "tables": np.zeros_like(self.tables)}
            f = np.broadcast_to(np.arange(FILTERS), place.shape)
            for k in range(WIDTH):
                np.add.at(g["tables"][k], (w.codes[place + k], f), back)
            step = min(step + 1, STEPS)
            flat = np.concatenate([np.ravel(g[p]) for p in PARAMS])
            m = 0.9 * m + 0.1 * flat
            v = 0.999 * v + 0.001 * flat**2
            move = 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            self.load(np.concatenate([self.state()[:n] - move, m, v, [step]]))

    def train(self, items: list[tuple[str, int, int]], label: np.ndarray, seed: int = 7) -> None:
        """All epochs over items at hand."""
        for number in range(EPOCHS):
            self.epoch(items, label, seed + number)

    def calibrate(self, items: list[tuple[str, int, int]], label: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling of items at hand, then the highest threshold that keeps the recall."""
        z = self.logits(Windows(items))
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
            a, b = a - 0.1 * np.mean((p - label) * z) - 1e-4 * a, b - 0.1 * np.mean(p - label)
        self.scale, self.shift = a, b
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        self.threshold = float(np.quantile(p[label == 1], 1 - recall, method="lower"))


ALPHABETS = ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
             "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789_-")
PREFIXES = ("", "", "sk-", "ghp_", "xoxb-", "pk_live_", "glpat-", "AIza", "key-", "eyJ")


Finding = tuple[int, str, str, str, str]  # label (-1: none here), left context, token, right context, some text nearby


def findings(text: str) -> list[Finding]:
    """What a whole text offers for training: rule findings (1), candidates no rule fits (0), or plain text (-1)."""
    spans = rule_spans(text)
    runs = open_runs(text, spans)
    at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, len(text) - 200)
    near = text[at:at + 200]
    out = [(y, text[max(0, a - BEFORE):a], text[a:b], text[b:b + AFTER], near)
           for y, places in ((1, [s[3:] for s in spans]), (0, runs)) for a, b in places if b - a <= LONGEST]
    return out or [(-1, "", "", "", near)]


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "t"):
            rows = [f for t in part.column("t").to_pylist() for f in findings(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32()] + [pa.string()] * 4, strict=True)],
                                             ["y", "l", "t", "r", "near"])


def labelled(found: list[Finding], size: int, seed: int = 7) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """(text, start, end) items and labels: the findings, and ``size`` variants of either label (see the module)."""
    r = np.random.default_rng(seed)
    items, labels = [], []

    def add(left: str, token: str, right: str, label: int) -> None:
        items.append((left + token + right, len(left), len(left) + len(token)))
        labels.append(label)

    for y, left, token, right, _ in found:
        if y >= 0:
            add(left, token, right, y)
    texts = [f[4].split() or ["x"] for f in found]
    values = [f[2] for f in found if f[0] == 1 and len(f[2]) >= 16]
    if not any(f[0] == 1 for f in found):
        return items, np.array(labels, float)
    num = lambda n: "".join("0123456789"[i] for i in r.integers(0, 10, n))
    for i in range(size):
        words = texts[r.integers(len(texts))]
        say = lambda n, words=words: " ".join(words[j] for j in r.integers(0, len(words), n))
        some = lambda words=words: re.sub(r"[^A-Za-z0-9]", "", words[r.integers(len(words))]) or "x"
        chars = ALPHABETS[i % len(ALPHABETS)]
        drawn = PREFIXES[i % len(PREFIXES)] + "".join(chars[j] for j in r.integers(0, len(chars), int(r.integers(20, 48))))
        token = values[r.integers(len(values))] if values and i % 4 == 0 else drawn
        left, right = (say(3) + " ", " " + say(2)) if i % 2 else (say(1) + f' {KEYWORDS[r.integers(len(KEYWORDS))]} = "', '" ' + say(1))
        add(left, token, right, 1)
        hard = [f"{some()}_{some()}_{some()}{num(2)}", f"{some()}/{some()}/{some()}-{num(4)}", f"{num(4)}-{num(2)}-{num(2)}T{num(6)}Z",
                f"{some()}-{some()}-{some()}-{num(3)}", f"{some()}{some()}{some()}{num(1)}", f"{some()}{num(4)}{some()}"][i % 6]
        while len(hard) < 16:
            hard += some()
        add(say(3) + " ", hard, " " + say(2), 0)
    return items, np.array(labels, float)


def _shard(key: tuple, rows: pa.Table) -> pa.Table:
    """A half of a shard as one row: its findings in order of their hash, with variants, and their labels."""
    half, shard = (k.as_py() for k in key)
    found = [tuple(r[c] for c in ("y", "l", "t", "r", "near")) for r in rows.sort_by("h").to_pylist()]
    items, label = labelled(found, max(VARIANTS, sum(f[0] == 1 for f in found)), 7 + half + 2 * shard)
    text, a, b = zip(*items, strict=True) if items else ((), (), ())
    return pa.table({"half": pa.array([half], pa.int32()), "shard": pa.array([shard], pa.int64()), "n": pa.array([len(items)], pa.int64()),
                     "positives": pa.array([int(label.sum())], pa.int64()), "text": pa.array([text], pa.list_(pa.string())),
                     "a": pa.array([a], pa.list_(pa.int32())), "b": pa.array([b], pa.list_(pa.int32())), "y": pa.array([label], pa.list_(pa.float64()))})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, int, int]], np.ndarray]]:
    """(shard, items, labels), a shard at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if r["text"]:
                yield r["shard"], list(zip(r["text"], r["a"], r["b"], strict=True)), np.array(r["y"], float)


def _epoch(sent, number: int, total: int):
    """mapInArrow body: the sum of the states that a task's shards reach from the shared one, each by its share of the items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start: Network = shared(sent)
        state, out = start.state(), None
        for shard, items, label in _rows(batches):
            start.load(state)
            start.epoch(items, label, 7 + number + EPOCHS * shard)
            own = np.rint(start.state() * (len(items) / total) * UNIT).astype(np.int64)
            out = own if out is None else out + own
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["state"])
    return run


def _logits(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared(sent)
        for _, items, label in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(net.logits(Windows(items))), pa.array(label)], ["z", "y"])
    return run


def calibrate_all(net: Network, scores: DataFrame, recall: float = RECALL) -> None:
    """Platt scaling of (z, y) by Newton steps, then the highest threshold that keeps the recall; all rows take part."""
    a, b, ridge = 1.0, 0.0, 1e-3
    for _ in range(15):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.lit(a) * F.col("z") + F.lit(b)))))
        w = p * (1 - p)
        ga, gb, aa, ab, bb = scores.agg(*[F.avg(x) for x in ((p - F.col("y")) * F.col("z"), p - F.col("y"), w * F.col("z") ** 2, w * F.col("z"), w)]).first()
        step = np.linalg.solve([[aa + ridge, ab], [ab, bb + ridge]], [ga + ridge * a, gb + ridge * b])
        step *= min(1.0, 1 / max(1e-12, np.abs(step).max()))
        a, b = max(0.01, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    # Sums of tasks in another order differ in their last digits only.
    net.scale, net.shift = round(float(a), 6), round(float(b), 6)
    good = scores.where("y = 1")
    n, lo, hi = good.agg(F.count(F.lit(1)), F.min("z"), F.max("z")).first()
    rank, part = int((1 - recall) * (n - 1)), F.floor((F.col("z") - F.lit(lo)) / F.lit(max(hi - lo, 1e-300)) * 1000)
    for at, some in sorted(good.groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect()):  # at most 1,001 rows
        if rank < some:
            z = good.where(part == at).orderBy("z").offset(rank).first()["z"]
            net.threshold = float(1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -60, 60))))
            return
        rank -= some


def fit(docs: DataFrame, text: str = "text", size: int = SHARD) -> Network:
    """Train and calibrate on all distinct findings of the corpus, ``size`` to a shard (see the module)."""
    spark = docs.sparkSession
    d = docs.select(F.col(text).alias("t")).where("t is not null").mapInArrow(_findings, "y int, l string, t string, r string, near string")
    d = d.withColumn("h", F.xxhash64("y", "l", "t", "r", "near"))
    # Equal findings count once; shard and half follow from the hash, so nothing depends on the order of rows.
    d = cut_lineage(d.groupBy("h").agg(*[F.any_value(c).alias(c) for c in ("y", "l", "t", "r", "near")]), "findings")
    shards = max(1, -(-d.count() // size))
    own = d.withColumns({"half": F.pmod("h", F.lit(2)).cast("int"), "shard": F.pmod(F.xxhash64("h"), F.lit(shards))})
    kinds = "half int, shard long, n long, positives long, text array<string>, a array<int>, b array<int>, y array<double>"
    # A few rows, much work each: apart, so that they are read by many tasks.
    items = cut_lineage(own.groupBy("half", "shard").applyInArrow(_shard, kinds).repartition(min(2 * shards, 512)), "items")
    forget(d)
    net = Network()
    parts = {r["half"]: (r["n"], r["positives"]) for r in items.groupBy("half").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives")).collect()}
    if len(parts) == 2 and all(0 < positives < n for n, positives in parts.values()):
        for number in range(EPOCHS):
            sent = share(spark, net)
            sums = items.where("half = 0").mapInArrow(_epoch(sent, number, parts[0][0]), "state binary").toLocalIterator()
            net.load(sum(np.frombuffer(r["state"], np.int64) for r in sums) / UNIT)
            sent.unpersist()
        net.moments = None
        scores = cut_lineage(items.where("half = 1").mapInArrow(_logits(share(spark, net)), "z double, y double"), "scores")
        calibrate_all(net, scores)
        forget(scores)
    forget(items)
    return net


def all_spans(texts: list[str], net: Network) -> list[list[Span]]:
    """Rule spans and model spans of each text, in order."""
    spans = [rule_spans(t) for t in texts]
    open_ = [(i, a, b) for i, t in enumerate(texts) for a, b in open_runs(t, spans[i])]
    p = net.probabilities([(texts[i], a, b) for i, a, b in open_])
    for (i, a, b), x in zip(open_, p, strict=True):
        if x >= net.threshold:
            spans[i].append(("model", a, b, a, b))
    return [sorted(s, key=lambda s: (s[1], KINDS.index(s[0]))) for s in spans]


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each secret (the value, not its keyword) replaced."""
    out, at = [], 0
    for a, b in sorted((s[3], s[4]) for s in spans):
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join([*out, text[at:]])


def _scan(sent, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared(sent)
        for batch in batches:
            for part in text_slices(batch, "_text"):
                texts = [t or "" for t in part.column("_text").to_pylist()]
                spans = all_spans(texts, net)
                base = [[s for s in x if s[0] != "model"] for x in spans]
                count = lambda kind, spans=spans: pa.array([sum(s[0] == kind for s in x) for x in spans], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in columns], count("assign"), count("access"), count("hex"), count("model"),
                     pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base]), pa.array([joined(x) for x in spans], pa.string())],
                    [*columns, "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"])
    return run


def _redact(sent, at: int, length: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared(sent)
        for batch in batches:
            for part in text_slices(batch, batch.schema.names[at]):
                old = part.column(at).to_pylist()
                spans = all_spans([t or "" for t in old], net)
                new = [redacted(t, s) if t and s else t for t, s in zip(old, spans, strict=True)]
                columns = list(part.columns)
                columns[at] = pa.array(new, part.schema.field(at).type)
                if length is not None:
                    sizes = [n if t is o else len(t) for n, t, o in zip(part.column(length).to_pylist(), new, old, strict=True)]
                    columns[length] = pa.array(sizes, part.schema.field(length).type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)
    return run


def scan(docs: DataFrame, net: Network, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of the documents with counts per kind and spans."""
    d = docs.select(*columns, F.col(text).alias("_text"))
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1]])
    return d.mapInArrow(_scan(share(docs.sparkSession, net), columns),
                        f"{kinds}, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string")


def redact(docs: DataFrame, net: Network, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with secrets replaced in the text; the length column follows where the text changed."""
    at = docs.columns.index(text)
    long = docs.columns.index(length) if length in docs.columns else None
    return docs.mapInArrow(_redact(share(docs.sparkSession, net), at, long), docs.schema)


def op2(docs: DataFrame) -> DataFrame:
    return scan(docs, fit(docs), ["doc_id"])
