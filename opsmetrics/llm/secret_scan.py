"""Secrets in text: fixed patterns, and a character network over every other candidate.

The patterns give the base findings. A candidate is any long run of the characters secrets
are made of, with a letter and a digit. A small convolutional network reads the candidate
and the text around it, character by character; long ones in overlapping pieces, of which
the highest score counts. It learns from base findings against the candidates that ordinary
text is full of, and its limit is the largest at which a fold it has not seen still recalls
nearly all base findings, however low that is.

Every finding of every document teaches or sets the limit. They are dealt to shards by hash,
each shard goes on from the same network, and their mean, weighted by their findings, is the
network of the next round.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.tables import fold, materialize
from opsmetrics.llm.text import slices, texts_of

KINDS = ("assign", "access", "hex", "network")
# The patterns of the base findings and the least length of what they find.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
INSIDE, AROUND = 40, 16
# Findings of a shard, rounds of shards, and passes of a round over a shard: as many as make
# ``STEPS`` batches, at most ``EPOCHS``.
SHARD = 1 << 17
ROUNDS = 2
STEPS = 1024
EPOCHS = 15
BATCH = 128
RECALL = 0.99
# The limit of a network without held-out findings to set one.
LEAST_LIMIT = 0.9


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings, by start, then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text)
             if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of at least 12 characters of keys and codes, with a letter and a digit."""
    spans = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if not run.isalpha() and any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            spans.append(m.span())
    return spans


# Character classes the network sees: each digit and letter alike by kind, and what
# binds a value to its name.
_CLASSES = ["[a-f]", "[g-z]", "[A-F]", "[G-Z]", "[0-9]", r"\s", "[=]", "[:]", "[\"']", "[_]",
            r"[-+/.]", r"[@]", r"[^\x00-\x7f]"]
CHANNELS = len(_CLASSES) + 2
WIDTH = INSIDE + 2 * AROUND


def _table() -> np.ndarray:
    table = np.full(129, len(_CLASSES), np.int8)
    for code in range(128):
        for number, pattern in enumerate(_CLASSES):
            if re.fullmatch(pattern, chr(code)):
                table[code] = number
                break
    table[128] = len(_CLASSES) - 1
    return table


_TABLE = _table()
PAD = CHANNELS - 1


def pieces(span: tuple[int, int]) -> list[tuple[int, int]]:
    """The span in parts of at most ``INSIDE`` characters, each half over the one before."""
    start, end = span
    if end - start <= INSIDE:
        return [span]
    starts = [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]
    return [(at, at + INSIDE) for at in starts]


def windows(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Classes of the characters before, in and after each span of at most ``INSIDE``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    start, end = np.array(spans, np.int64).reshape(-1, 2).T[..., None]
    column = np.arange(WIDTH)
    place = np.where(column < AROUND + INSIDE, start - AROUND + column,
                     end - AROUND - INSIDE + column)
    there = ((place >= 0) & (place < len(points))
             & ((column < AROUND) | (column >= AROUND + INSIDE) | (place < end)))
    out = np.full(place.shape, PAD, np.int8)
    out[there] = _TABLE[np.minimum(points[place[there]], 128)]
    return out


@dataclass
class Network:
    """Convolution of ``TAPS`` characters, maxima over the candidate and over what is around
    it, one logistic unit; a slope and offset that calibrate it, the limit, and the share of
    held-out base findings it recalls there."""

    filters: np.ndarray
    bias: np.ndarray
    output: np.ndarray
    offset: float
    scale: tuple[float, float] = (1.0, 0.0)
    limit: float = LEAST_LIMIT
    recall: float | None = None

    def scores(self, classes: np.ndarray) -> np.ndarray:
        return _scores(self, _decisions(self, classes))


FILTERS, TAPS = 12, 5


def _forward(net: Network, classes: np.ndarray):
    """Decision, pooled features, and where each maximum lies."""
    places = WIDTH - TAPS + 1
    total = np.broadcast_to(net.bias, (len(classes), places, FILTERS)).copy()
    for tap in range(TAPS):
        total += net.filters[tap][classes[:, tap:tap + places]]
    np.maximum(total, 0, out=total)
    inside = slice(AROUND - TAPS // 2, AROUND + INSIDE - TAPS // 2)
    outer = total.copy()
    outer[:, inside] = 0
    tops = [total[:, inside].argmax(axis=1) + inside.start, outer.argmax(axis=1)]
    rows, columns = np.arange(len(classes))[:, None], np.arange(FILTERS)
    mean = total[:, inside].mean(axis=1)
    pooled = np.concatenate([total[rows, tops[0], columns], outer[rows, tops[1], columns], mean],
                            axis=1)
    return pooled @ net.output + net.offset, pooled, tops, total


def new_network(seed: int = 10) -> Network:
    random = np.random.default_rng(seed)
    return Network(random.normal(0, 0.3, (TAPS, CHANNELS, FILTERS)), np.zeros(FILTERS),
                   random.normal(0, 0.3, 3 * FILTERS), 0.0)


def _spread(target: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """All rows in a random order in which each label is spread evenly."""
    at = np.empty(len(target))
    for rows in (np.flatnonzero(target > 0), np.flatnonzero(target <= 0)):
        rows = random.permutation(rows)
        at[rows] = (np.arange(len(rows)) + random.random()) / max(len(rows), 1)
    return np.argsort(at, kind="stable")


def train(classes: np.ndarray, target: np.ndarray, epochs: int = 30, batch: int = BATCH,
          rate: float = 0.01, seed: int = 10, start: Network | None = None,
          share: float | None = None) -> Network:
    """Adam on the log loss, both labels weighing the same where ``share`` of the targets are
    1 (those given, by default); it goes on from ``start``, which stays as it is."""
    random = np.random.default_rng(seed)
    begin = start or new_network(seed)
    net = Network(begin.filters.copy(), begin.bias.copy(), begin.output.copy(), begin.offset)
    parameters = [net.filters, net.bias, net.output, np.array([net.offset])]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    share = target.mean() if share is None else share
    weight = np.where(target > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    inside = slice(AROUND - TAPS // 2, AROUND + INSIDE - TAPS // 2)
    one = np.eye(CHANNELS, dtype=np.float32)
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(_spread(target, random), len(target) // batch + 1):
            step += 1
            net.offset = float(parameters[3][0])
            z, pooled, tops, total = _forward(net, classes[rows])
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[rows]) * weight[rows]
            error /= len(rows)
            back = error[:, None] * net.output
            active = np.zeros(total.shape, np.float32)
            index = np.arange(len(rows))[:, None], np.arange(FILTERS)
            for part, top in enumerate(tops):
                active[index[0], top, index[1]] += back[:, part * FILTERS:(part + 1) * FILTERS]
            active[:, inside] += back[:, None, 2 * FILTERS:] / INSIDE
            active *= total > 0
            places = WIDTH - TAPS + 1
            seen, flat = one[classes[rows]], active.reshape(-1, FILTERS)
            filters = np.stack([seen[:, tap:tap + places].reshape(-1, CHANNELS).T @ flat
                                for tap in range(TAPS)])
            gradients = [filters, active.sum(axis=(0, 1)), pooled.T @ error,
                         np.array([error.sum()])]
            for p, g, (m, v) in zip(parameters, gradients, state):
                g = g + 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    net.offset = float(parameters[3][0])
    return net


def _decisions(net: Network, classes: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """The decision on each window, or the highest of the pieces from each of ``first`` on."""
    z = np.concatenate([_forward(net, c)[0] for c in np.array_split(
        classes, len(classes) // 512 + 1)]) if len(classes) else np.zeros(0)
    return np.maximum.reduceat(z, first) if first is not None and len(z) else z


def _fit_scale(sums, spread: float) -> tuple[float, float]:
    """Slope and offset that make decisions log odds, by Newton steps. ``sums`` gives the
    gradient (2) and the hessian (00, 01, 11) over all findings at a slope and an offset of
    decisions divided by ``spread``."""
    at = np.zeros(2)
    for _ in range(50):
        g0, g1, h00, h01, h11 = sums(at)
        hessian = np.array([[h00, h01], [h01, h11]]) + 1e-2 * np.eye(2)
        move = np.clip(np.linalg.solve(hessian, np.array([g0, g1]) - 1e-2 * at), -2, 2)
        at += move
        if np.abs(move).max() < 1e-10:
            break
    return float(at[0] / spread), float(at[1])


def calibrate(net: Network, classes: np.ndarray, target: np.ndarray,
              recall: float = RECALL, first: np.ndarray | None = None) -> None:
    """Set slope, offset and limit on findings the network has not learnt from.

    ``first`` says where the pieces of each finding begin, if not one each. The limit is the
    largest that still recalls ``recall`` of the positives.
    """
    z = _decisions(net, classes, first)
    if len(set(target.tolist())) == 2:
        x = z / (z.std() + 1e-9)

        def sums(at):
            p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -30, 30)))
            q = p * (1 - p)
            return ((target - p) @ x, (target - p).sum(), q @ (x * x), q @ x, q.sum())

        net.scale = _fit_scale(sums, z.std() + 1e-9)
    scores = _scores(net, z)
    positive = np.sort(scores[target > 0])
    if len(positive):
        net.limit = float(positive[int((1 - recall) * len(positive))])
        net.recall = float((positive >= net.limit).mean())


def _scores(net: Network, z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.scale[0] * z + net.scale[1], -30, 30)))


def calibrate_on(net: Network, held: DataFrame, recall: float = RECALL) -> None:
    """``calibrate`` on a table of findings, whose decisions stay in Spark: what comes back
    are sums, and the decision at the limit."""
    decided = materialize(held.mapInArrow(partial(_decide, net=net), "label int, z double"))
    of = decided.agg(F.count("z").alias("n"), F.sum("label").alias("positive"),
                     F.stddev_pop("z").alias("spread")).first()
    if not of.positive:
        return
    if of.positive < of.n:
        spread = of.spread + 1e-9
        x = F.col("z") / spread

        def sums(at):
            odds = F.least(F.greatest(x * float(at[0]) + float(at[1]), F.lit(-30.0)), F.lit(30.0))
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
            q, error = p * (F.lit(1.0) - p), F.col("label") - p
            return decided.agg(F.sum(error * x), F.sum(error), F.sum(q * x * x), F.sum(q * x),
                               F.sum(q)).first()

        net.scale = _fit_scale(sums, spread)
    rising = F.col("z") * (1.0 if net.scale[0] >= 0 else -1.0)
    positive = decided.filter("label = 1").select("z", rising.alias("rising"))
    least = positive.orderBy("rising").offset(int((1 - recall) * of.positive)).first()
    net.limit = float(_scores(net, np.array([least.z]))[0])
    net.recall = positive.filter(F.col("rising") >= least.rising).count() / of.positive


def _pieces_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all pieces of findings, and how many each finding has."""
    found = [np.frombuffer(w, np.int8).reshape(-1, WIDTH) for w in column.to_pylist()]
    return np.concatenate(found), np.array([len(f) for f in found])


def _decide(batches, net: Network):
    """The decision on each finding, with its label."""
    for batch in slices(batches, "window"):
        classes, sizes = _pieces_of(batch.column("window"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array(_decisions(net, classes, np.cumsum(sizes) - sizes))],
            names=["label", "z"])


def _findings(batches):
    """Windows of base findings (1) and of other candidates (0), and whether held out."""
    for batch in slices(batches):
        rows, labels, held = [], [], []
        for text, out in zip(texts_of(batch.column("text")), batch.column("_held").to_pylist()):
            base = base_spans(text)
            values = {(s, e) for s, e, k in base if k != "assign"}
            if len(values) < len(base):
                values |= {m.span(2) for m in ASSIGN.finditer(text)
                           if m.end(2) - m.start(2) >= LEAST_ASSIGN}
            # Long plain words are what the network must leave alone.
            other = _apart([m.span() for m in CANDIDATE.finditer(text)], base)
            for label, spans in ((1, sorted(values)), (0, other)):
                if not spans:
                    continue
                parts = [pieces(s) for s in spans]
                seen = windows(text, [p for ps in parts for p in ps])
                ends = np.cumsum([len(ps) for ps in parts])
                rows += [seen[end - len(ps):end].tobytes() for ps, end in zip(parts, ends)]
                labels += [label] * len(spans)
                held += [out] * len(spans)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.binary()), pa.array(labels, pa.int32()), pa.array(held, pa.bool_())],
            names=["window", "label", "held"])


def _apart(spans: list[tuple[int, int]],
           base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The spans that meet no base finding."""
    if not base or not spans:
        return spans
    starts = np.array([s for s, _, _ in base])
    reach = np.maximum.accumulate([e for _, e, _ in base])
    before = np.searchsorted(starts, [e for _, e in spans])
    meets = (before > 0) & (reach[before - 1] > np.array([s for s, _ in spans]))
    return [s for s, x in zip(spans, meets) if not x]


def _touches(span: tuple[int, int], spans: list[tuple[int, int]]) -> bool:
    return any(span[0] < end and start < span[1] for start, end in spans)


def _train_shard(table, net, share, seed):
    """The parameters after the passes of a round over a shard, in an order of its own."""
    table = table.sort_by([("window", "ascending"), ("label", "ascending")])
    classes, sizes = _pieces_of(table.column("window"))
    target = np.repeat(table.column("label").to_numpy().astype(float), sizes)
    epochs = min(EPOCHS, -(-STEPS * BATCH // len(target)))
    taught = train(classes, target, epochs, seed=seed, start=net, share=share)
    return pa.table({
        "shard": table.column("shard")[:1], "n": pa.array([table.num_rows], pa.int64()),
        "parameters": pa.array([np.concatenate([
            taught.filters.ravel(), taught.bias, taught.output, [taught.offset]])],
            pa.list_(pa.float64()))})


def _mean_network(found: pa.Table) -> Network:
    """The mean of the shards' networks, each weighing as many findings as it has."""
    found = found.sort_by("shard")
    mean = np.average(found.column("parameters").combine_chunks().flatten().to_numpy()
                      .reshape(found.num_rows, -1), axis=0, weights=found.column("n").to_numpy())
    filters, bias, output, offset = np.split(
        mean, np.cumsum([TAPS * CHANNELS * FILTERS, FILTERS, 3 * FILTERS]))
    return Network(filters.reshape(TAPS, CHANNELS, FILTERS), bias, output, float(offset[0]))


def fit_network(docs: DataFrame, per_shard: int = SHARD, rounds: int = ROUNDS) -> Network | None:
    """Train on all findings of all documents with a text: base findings, and every other run
    of the characters of a candidate; findings with the same characters by class count once.
    Fold 0 sets scale and limit, the others, and rows without an id, teach. Without findings
    of both labels to learn from there is no network (None). This runs jobs; the driver holds
    one set of parameters for each ``per_shard`` findings.
    """
    found = materialize(
        docs.filter("text IS NOT NULL").select("text", (fold() == 0).alias("_held"))
        .mapInArrow(_findings, "window binary, label int, held boolean").distinct())
    number = {(r.held, r.label): r["count"]
              for r in found.groupBy("held", "label").count().collect()}
    clean, secret = (number.get((False, label), 0) for label in (0, 1))
    if not clean or not secret:
        return None
    shards = -(-(clean + secret) // per_shard)
    taught = found.filter("NOT held").select(
        "window", "label", F.pmod(F.xxhash64("window"), F.lit(shards)).alias("shard"))
    net = new_network()
    for seed in range(rounds):
        net = _mean_network(
            taught.groupBy("shard").applyInArrow(
                partial(_train_shard, net=net, share=secret / (clean + secret), seed=seed),
                "shard bigint, n bigint, parameters array<double>").toArrow())
    calibrate_on(net, found.filter("held"))
    return net


def _without_base(span: tuple[int, int], base: list[tuple[int, int, str]]):
    """The parts of a span that no base finding covers."""
    parts, at = [], span[0]
    for start, end, _ in base:
        if start < span[1] and end > at:
            if start > at:
                parts.append((at, start))
            at = end
    return parts + [(at, span[1])] if at < span[1] else parts


def added_spans(text: str, base: list[tuple[int, int, str]],
                net: Network | None) -> list[tuple[int, int, str]]:
    """Candidates that the network calls secrets, without what base findings cover.

    An assigned value takes in all characters of a candidate, and what lies before it is part
    of its name; so candidates that meet such a finding add nothing.
    """
    if net is None:
        return []
    assigned = [(s, e) for s, e, k in base if k == "assign"]
    rest = [(c, _without_base(c, base)) for c in candidates(text) if not _touches(c, assigned)]
    rest = [(c, parts) for c, parts in rest if parts]
    if not rest:
        return []
    split = [pieces(c) for c, _ in rest]
    sizes = np.array([len(p) for p in split])
    scores = np.maximum.reduceat(net.scores(windows(text, [p for ps in split for p in ps])),
                                 np.cumsum(sizes) - sizes)
    return [(*part, "network") for (_, parts), score in zip(rest, scores) if score >= net.limit
            for part in parts]


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _spans_of(text: str, net: Network | None):
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, net),
                        key=lambda s: (s[0], KINDS.index(s[2])))


_DIGEST = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def _scan(batches, net: Network | None):
    for batch in slices(batches):
        out: list[list] = [[], [], [], [], []]
        for text in texts_of(batch.column("text")):
            base, spans = _spans_of(text, net)
            for column, kind in zip(out, KINDS):
                column.append(sum(k == kind for _, _, k in base))
            out[3][-1] = hashlib.sha256(_joined(base).encode()).hexdigest()
            out[4].append(_joined(spans))
        done = batch.select(["doc_id"])
        for name, column in zip(("n_assign", "n_access", "n_hex", "base_sha256", "spans"), out):
            done = done.append_column(
                name, pa.array(column, pa.int64() if name[:2] == "n_" else pa.string()))
        yield done


def scan(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row of ``docs``.

    Spans are ``kind:start:end`` in code points, by start, then kind (assign, access, hex,
    network), joined by commas. The counts and the hash are of the base findings alone.
    Null and empty texts have none: counts 0, the hash of nothing, an empty string. Rows
    stay rows, also repeated ones and those with a null id. No rows give none. Other
    columns are not read. Without a network only base findings are given.
    """
    of_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        partial(_scan, net=net), f"doc_id {of_id}, {_DIGEST}")


def _redact(batches, net: Network | None, mark: str):
    for batch in slices(batches):
        texts, changed = batch.column("text").to_pylist(), False
        for number, text in enumerate(texts):
            spans = _spans_of(text, net)[1] if text else []
            if spans:
                texts[number], changed = _without(text, spans, mark), True
        if changed:
            place = batch.schema.get_field_index("text")
            batch = batch.set_column(place, batch.schema.field(place),
                                     pa.array(texts, batch.schema.field(place).type))
            if "n_chars" in batch.schema.names:
                place = batch.schema.get_field_index("n_chars")
                kind = batch.schema.field(place)
                sizes = [None if t is None else len(t) for t in texts]
                batch = batch.set_column(place, kind, pa.array(sizes).cast(kind.type))
        yield batch


def _without(text: str, spans, mark: str) -> str:
    parts, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, net: Network | None, mark: str = "[secret]") -> DataFrame:
    """``docs``, all columns and rows, with ``mark`` in place of every finding; overlapping
    findings get one mark. ``n_chars``, if there, follows the text."""
    return docs.mapInArrow(partial(_redact, net=net, mark=mark), docs.schema)
