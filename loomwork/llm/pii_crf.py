"""Personal data by a skip-chain conditional random field on top of the base patterns."""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomwork.llm.pii_spans import KINDS, base_spans, digits, is_card, is_phone, luhn

#: Kinds of spans; the last is the field's alone: passwords, keys and access tokens.
SPAN_KINDS = (*KINDS, "secret")
SECRET = len(KINDS)
LABELS = 1 + len(SPAN_KINDS)  # 0 is outside
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[0-9@]")
_SHAPES = [
    re.compile(p)
    for p in (
        r"[^@]+@[^@]+\.[A-Za-z0-9-]+",
        r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
        r"\+[0-9]{1,3}",
        r"\([0-9]{2,4}\)",
        r"[0-9]{3}[-.][0-9]{4}",
        r"[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}",
        r"[0-9]+",
        r"[0-9]{4}",
        r"[0-9]+[.,:/][0-9]+",
        r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
        r"00[0-9]{2,3}",
        r"[0-9a-f]{20,}|[0-9A-F]{20,}",
        r"[A-Z0-9]{16,}",
        r"(?:[A-Za-z_-]+[=:])?(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_=-]{12,}",
        r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    )
]
_TRIM = ".,;:!?\"'[]<>|{}#$%&*~`"
#: Words that announce a secret, and ones that announce a long number or digest that is none.
_ANNOUNCES = re.compile(r"(?i)token|secret|passw|pwd|credential|bearer|(?:^|[_-]|api)key(?:$|[=:])")
_DIGEST = re.compile(r"(?i)^\W*(?:commit|sha|md5|hash|checksum|digest|etag|uuid|rev|build|serial|order|part|isbn)")
_ASSIGNED = re.compile(r"[A-Za-z_-]*[=:]+")
_VALUE = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_=.!@#$%^&*~-]{8,}")
_STEPS = (1, 2, 3, 4, 5, 7, 9, 10, 11, 12, 16, 17, 20)


def _bin(n: int) -> int:
    return sum(n >= s for s in _STEPS)


BINS = len(_STEPS) + 1
WIDTH = 1 + 4 + 3 * len(_SHAPES) + 2 * BINS + 4 + 4


@dataclass
class Graph:
    """Tokens that hold a digit or @ (all others are outside by definition), their features and their edges."""

    spans: list[tuple[int, int]]
    features: np.ndarray  # nodes x WIDTH, 0 or 1
    chain: np.ndarray  # pairs of neighbouring tokens
    skip: np.ndarray  # pairs of equal or similar tokens, however far apart

    def __len__(self) -> int:
        return len(self.spans)


def build_graph(text: str) -> Graph:
    """Nodes, features and edges of one text.

    Skip edges join each token to the next one of the same key, so that m equal tokens cost m - 1 edges of each key. The
    keys are told by similar_keys: tokens are joined in other forms too.
    """
    spans, words, context = [], [], []
    before = ("", "")
    for k, m in enumerate(_TOKEN.finditer(text)):
        whole = m.group()
        if _MARK.search(whole):
            lead = len(whole) - len(whole.lstrip(_TRIM))
            core = whole.strip(_TRIM)
            if core:
                spans.append((m.start() + lead, m.start() + lead + len(core)))
                words.append((k, core))
                context.append(before)
        before = (before[1], whole)
    n = len(spans)
    features = np.zeros((n, WIDTH), dtype=np.uint8)
    numbers = [digits(w) for _, w in words]
    shapes = np.array([[bool(s.fullmatch(w)) for s in _SHAPES] for _, w in words], dtype=np.uint8).reshape(n, len(_SHAPES))
    near = np.array([words[i + 1][0] - words[i][0] == 1 for i in range(n - 1)], dtype=bool)
    runs = np.concatenate([[0], np.cumsum(~near)]) if n else np.zeros(0, dtype=np.int64)
    length = np.bincount(runs, weights=[len(d) for d in numbers]) if n else []
    for i, ((_, w), d) in enumerate(zip(words, numbers, strict=True)):
        row, at = features[i], 5
        row[0] = 1
        row[1], row[2] = any(c.isalpha() for c in w), "=" in w or "/" in w
        row[3], row[4] = 12 <= len(d) <= 19 and luhn(d), "@" in w
        row[at : at + len(_SHAPES)] = shapes[i]
        if i and near[i - 1]:
            row[at + len(_SHAPES) : at + 2 * len(_SHAPES)] = shapes[i - 1]
        if i + 1 < n and near[i]:
            row[at + 2 * len(_SHAPES) : at + 3 * len(_SHAPES)] = shapes[i + 1]
        at += 3 * len(_SHAPES)
        row[at + _bin(len(d))] = 1
        row[at + BINS + _bin(int(length[runs[i]]))] = 1
        at += 2 * BINS
        row[at], row[at + 1] = not i or not near[i - 1], i + 1 == n or not near[i]
        row[at + 2] = all(0 <= int(p) <= 255 for p in w.split(".")) if shapes[i][1] else 0
        row[at + 3] = len(d) == len(w)
        row[at + 4] = any(_ANNOUNCES.search(x) for x in context[i])
        row[at + 5] = context[i][1][-1:] in ("=", ":")
        row[at + 6] = bool(_ANNOUNCES.search(w))
        row[at + 7] = any(_DIGEST.search(x) for x in context[i])
    chain = np.flatnonzero(near)
    last: dict[tuple, int] = {}
    skip: dict[tuple[int, int], None] = {}
    for i, keys in enumerate(similar_keys([w for _, w in words], numbers, near)):
        for key in keys:
            if key in last and last[key] != i:
                skip[last[key], i] = None
            last[key] = i
    skip = list(skip)
    return Graph(spans, features, np.stack([chain, chain + 1], axis=1), np.array(skip, dtype=np.int64).reshape(-1, 2))


def similar_keys(words: list[str], numbers: list[str], near: np.ndarray) -> list[list[tuple]]:
    """For each token the keys by which others are similar to it.

    The last seven digits, where there are so many, else the bare lower-case token; the value behind an assignment; the
    first and the last ten characters of long mixed tokens, so that cut and wrapped ones meet; and in a row of number tokens
    the row's last seven digits with the token's distance from its end, so that `+1 (212) 555-1234` meets `212 555 1234`
    part by part.
    """
    n = len(words)
    keys: list[list[tuple]] = [[] for _ in range(n)]
    for i, (w, d) in enumerate(zip(words, numbers, strict=True)):
        plain = d[-7:] if len(d) >= 7 else w.lower()
        if len(plain) >= 4:
            keys[i].append(("same", plain))
        front = m.end() if (m := _ASSIGNED.match(w)) else 0
        value = w[front:].strip(_TRIM).lower()
        if len(value) >= 8:
            keys[i].append(("value", value))
        if len(value) >= 16 and d and any(c.isalpha() for c in value):
            keys[i] += [("front", value[:10]), ("back", value[-10:])]
    number = [bool(d) and not any(c.isalpha() or c == "@" for c in w) for w, d in zip(words, numbers, strict=True)]
    i = 0
    while i < n:
        j = i
        while number[i] and j + 1 < n and near[j] and number[j + 1] and j - i < 8:
            j += 1
        row = "".join(numbers[i : j + 1])
        if number[i] and 9 <= len(row) <= 19:
            after = 0
            for k in range(j, i - 1, -1):
                keys[k].append(("row", row[-7:], after))
                after += len(numbers[k])
        i = j + 1
    return keys


def joined(graphs: list[Graph]) -> Graph:
    """Many graphs as one without edges between them, so that all pass messages in the same array steps."""
    starts = np.concatenate([[0], np.cumsum([len(g) for g in graphs])])
    return Graph(
        [s for g in graphs for s in g.spans],
        np.concatenate([g.features for g in graphs]),
        np.concatenate([g.chain + a for g, a in zip(graphs, starts, strict=False)]),
        np.concatenate([g.skip + a for g, a in zip(graphs, starts, strict=False)]),
    )


@dataclass
class Field:
    """Weights: features x labels, and a table of labels x labels for either kind of edge."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def infer(self, graph: Graph, rounds: int = 20, start: np.ndarray | None = None, owner: np.ndarray | None = None):
        """Loopy sum-product: marginals and messages (chain edges' first, then skip edges', then all of them backwards).

        owner tells each node's graph where many are joined: a graph's messages stay as they are once none of them
        moves by 1e-3, so its marginals don't depend on the graphs beside it.
        """
        unary = np.concatenate([graph.features[at : at + 65_536] @ self.node for at in range(0, len(graph.features), 65_536)] or [np.zeros((0, LABELS))])
        edges = np.concatenate([graph.chain, graph.skip])
        m, chains = len(edges), len(graph.chain)
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        # exp(potentials) of the edges' four runs; messages are sums over the sending node's labels.
        runs = [(slice(0, chains), self.chain), (slice(chains, m), self.skip), (slice(m, m + chains), self.chain.T), (slice(m + chains, 2 * m), self.skip.T)]
        runs = [(place, np.exp(table)) for place, table in runs]
        message = np.zeros((2 * m, LABELS)) if start is None else start
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)]) if m else np.zeros(0, dtype=np.int64)
        graphs = np.zeros(len(source), dtype=np.int64) if owner is None else owner[source]
        moving = np.ones(int(graphs.max()) + 1 if len(graphs) else 0, dtype=bool)

        def beliefs():
            b = unary.copy()
            np.add.at(b, target, message)
            return b

        for _ in range(rounds if m else 0):
            out = beliefs()[source] - message[back]
            top = out.max(axis=1, keepdims=True)
            weight = np.exp(out - top)
            fresh = np.empty_like(message)
            for place, table in runs:
                fresh[place] = np.log(weight[place] @ table)
            fresh += top
            fresh -= fresh.max(axis=1, keepdims=True)
            change = np.zeros(len(moving))
            np.maximum.at(change, graphs, np.abs(fresh - message).max(axis=1))
            message = np.where(moving[graphs][:, None], 0.5 * message + 0.5 * fresh, message)
            moving &= change >= 1e-3
            if not moving.any():
                break
        b = beliefs()
        marginals = np.exp(b - b.max(axis=1, keepdims=True))
        return marginals / marginals.sum(axis=1, keepdims=True), message

    def edge_beliefs(self, graph: Graph, message: np.ndarray) -> np.ndarray:
        """Joint marginals of the ends of every edge, chain edges first."""
        b = graph.features @ self.node
        edges = np.concatenate([graph.chain, graph.skip])
        m = len(edges)
        np.add.at(b, np.concatenate([edges[:, 1], edges[:, 0]]), message)
        pair = np.concatenate([np.broadcast_to(self.chain, (len(graph.chain), LABELS, LABELS)), np.broadcast_to(self.skip, (len(graph.skip), LABELS, LABELS))])
        both = (b[edges[:, 0]] - message[m:])[:, :, None] + (b[edges[:, 1]] - message[:m])[:, None, :] + pair
        both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
        return both / both.sum(axis=(1, 2), keepdims=True)


def fit(graph: Graph, labels: np.ndarray, steps: int = 120, rate: float = 0.2, decay: float = 3e-4) -> Field:
    """Weights by gradient ascent on the likelihood that the messages approximate; label -1 is unknown and left out."""
    field = Field(np.zeros((WIDTH, LABELS)), np.zeros((LABELS, LABELS)), np.eye(LABELS))
    known = labels >= 0
    truth = np.eye(LABELS)[np.maximum(labels, 0)]
    edges = np.concatenate([graph.chain, graph.skip])
    both_known = known[edges].all(axis=1) if len(edges) else np.zeros(0, dtype=bool)
    pairs = truth[edges[:, 0]][:, :, None] * truth[edges[:, 1]][:, None, :]
    cut = len(graph.chain)
    means, squares, message = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0], None
    features = graph.features.astype(np.float64)
    dense = Graph(graph.spans, features, graph.chain, graph.skip)
    for step in range(1, steps + 1):
        marginals, message = field.infer(dense, rounds=4, start=message)
        gap = (pairs - field.edge_beliefs(dense, message)) * both_known[:, None, None]
        gradients = [
            features.T @ ((truth - marginals) * known[:, None]) / max(1, known.sum()),
            gap[:cut].sum(axis=0) / max(1, both_known[:cut].sum()),
            gap[cut:].sum(axis=0) / max(1, both_known[cut:].sum()),
        ]
        gradients[2] = (gradients[2] + gradients[2].T) / 2
        for k, (name, g) in enumerate(zip(("node", "chain", "skip"), gradients, strict=True)):
            w = getattr(field, name)
            g = g - decay * w
            means[k], squares[k] = 0.9 * means[k] + 0.1 * g, 0.99 * squares[k] + 0.01 * g * g
            w += rate * (means[k] / (1 - 0.9**step)) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-6)
    return field


def node_labels(graph: Graph, base: list[tuple[int, int, int]], failed: list[tuple[int, int]]) -> np.ndarray:
    """Labels of nodes by known spans: a token mostly inside one has its kind; inside a failed match it is unknown.

    Spans of one kind don't overlap, so each kind is searched by bisection; of several kinds the first counts.
    """
    labels = np.zeros(len(graph), dtype=np.int64)
    lists = [(kind + 1, [s for s in base if s[2] == kind]) for kind in range(len(SPAN_KINDS))]
    merged: list[list[int]] = []
    for a, b in sorted(failed):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for label, spans in [*lists, (-1, merged)]:
        ends = [s[1] for s in spans]
        for i, (a, b) in enumerate(graph.spans if spans else []):
            k = bisect_right(ends, a)
            while not labels[i] and k < len(spans) and spans[k][0] < b:
                share = 0.25 if label == SECRET + 1 else 0.6  # of an assignment the value alone is the secret
                if label < 0 or min(b, spans[k][1]) - max(a, spans[k][0]) >= share * (b - a):
                    labels[i] = label
                k += 1
    return labels


def made_up(count: int, seed: int) -> list[tuple[Graph, np.ndarray]]:
    """Training texts with known labels: each kind in forms the base patterns miss too, and numbers of other sorts."""
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        front = rng.choice("3456") + number(rng.choice((13, 14, 14, 14)))
        whole = front + next(c for c in "0123456789" if luhn(front + c))
        return whole if rng.random() < 0.6 or len(whole) != 16 else rng.choice(" -").join(whole[i : i + 4] for i in (0, 4, 8, 12))

    def bad_card() -> str:
        whole = number(16)
        return whole if not luhn(whole) else whole[:-1] + str((int(whole[-1]) + 1) % 10)

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"{a}-{b}-{c}", f"+{number(2)} {a} {b}{c}", f"+1{a}{b}{c}"))

    def secret() -> tuple[str, int]:
        """A key word, perhaps a sign, and the value, whose place in the whole is told."""
        value = rng.choice(
            (
                lambda: mixed("abcdef0123456789", rng.choice((16, 18, 32, 40, 64))),
                lambda: rng.choice(("AK", "AKIA", "")) + mixed("ABCDEFGHKLMQRST0123456789", 16),
                lambda: mixed("abcdefghikmnopqrstuvwxyzABCDEFGHKLMNOPQRSTUVWXYZ0123456789_-", rng.randint(12, 44)),
            )
        )()
        name = rng.choice(("token", "secret", "password", "api_key", "key", "TOKEN", "access-key", "auth_token", "client_secret", "pwd"))
        front = rng.choice((f'{name} = "', f"{name}: ", f"{name}=", f'{name}="', f"{name} ", "Bearer ", f"{name} is "))
        return front + value + ('"' if '"' in front else ""), len(front)

    def mixed(letters: str, n: int) -> str:
        """At least one digit and one letter."""
        made = "".join(rng.choice(letters) for _ in range(n - 2))
        return rng.choice([c for c in letters if c.isalpha()]) + made + rng.choice("0123456789")

    makers = [
        (lambda: f"{word()}{rng.choice(('', '.', '_'))}{number(rng.randint(0, 3))}@{word()}{number(rng.randint(0, 1))}.{rng.choice(('com', 'org', 'example.com'))}", 1),
        (lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4)), 2),
        (card, 3),
        (phone, 4),
        (secret, 5),
    ]
    others = [
        lambda: str(rng.randint(1900, 2030)), lambda: number(rng.randint(1, 3)), lambda: f"{number(2)}.{number(2)}", lambda: f"{number(1)}.{number(1)}.{number(1)}",
        lambda: f"20{number(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", lambda: bad_card(), lambda: f"{rng.randint(0, 23)}:{number(2)}", lambda: number(rng.randint(5, 11)),
        lambda: rng.choice(("commit ", "sha256 ", "sha1: ", "md5 = ", "checksum ", "digest: ", "etag ", "rev ", "", "")) + mixed("abcdef0123456789", rng.choice((16, 20, 32, 40, 64))),
        lambda: "-".join(mixed("abcdef0123456789", n) for n in (8, 4, 4, 4, 12)), lambda: rng.choice(("serial ", "order ", "part ", "")) + mixed("ABCDEFGHKLMNPQRST0123456789", rng.randint(8, 20)),
        lambda: word() + number(2), lambda: f"{number(1)},{number(3)}", lambda: "@" + word(),
        lambda: f"{number(3)} {number(3)} {number(4)}", lambda: number(10), lambda: mixed("ABCDEFGHKLMNPQRST0123456789", 20),
        lambda: f"({number(1)})", lambda: f"{number(3)}-{number(2)}", lambda: f"{number(3)}-{number(4)}", lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)),
    ]
    def again(piece: str, label: int) -> str:
        """A repeat, perhaps in a form that tells nothing by itself."""
        d = digits(piece)
        if label == 4 and len(d) >= 10:
            a, b, c = d[-10:-7], d[-7:-4], d[-4:]
            return rng.choice((piece, f"{a} {b} {c}", f"{a} {b} {c}", f"{b}-{c}", a + b + c, f"{a}.{b}.{c}"))
        return rng.choice((piece, d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)))) if label == 3 else piece

    out = []
    for _ in range(count):
        text, truth = word(), []
        kept: list[tuple[str, int]] = []
        for _ in range(rng.randint(1, 6)):
            front = 0
            if kept and rng.random() < 0.35:
                piece, label = rng.choice(kept)
                piece = again(piece, label)
            elif rng.random() < 0.55:
                make, label = rng.choice(makers)
                piece = make()
                if label == 5:
                    piece, front = piece
                kept.append((piece[front:].rstrip('"'), label))
            else:
                piece, label = rng.choice(others)(), 0
            text += " " + " ".join(word() for _ in range(rng.choice((0, 1, 1, 2, 3))))
            text = text.rstrip() + " "
            if label:
                truth.append((len(text) + front, len(text) + len(piece.rstrip('"')), label - 1))
            text += piece + rng.choice(("", "", ".", ","))
        graph = build_graph(text)
        labels = node_labels(graph, truth, [])
        out.append((graph, labels))
    return out


def train(docs: DataFrame, text_col: str = "text", train_docs: int = 8_000, doc_nodes: int = 100, made: int = 1_500, seed: int = 5) -> Field:
    """Fit the field on made-up texts and on a bounded sample of the corpus that the base patterns label.

    At most train_docs distinct texts, those of least hash, and at most doc_nodes nodes of each count; the bounds
    hold for fitting alone. What looks like a secret in the corpus is unknown, as no base pattern tells. Graphs are
    built on the executors, only features, labels and edges come to the driver.
    """
    n = docs.count()
    marked = docs.select(F.xxhash64(F.lit(seed), text_col).alias("mark"), F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    if n > train_docs:
        marked = marked.where(F.pmod("mark", F.lit(1 << 30)) < int(train_docs / n * (1 << 30)))
    least = marked.select("mark").distinct().orderBy("mark").limit(train_docs)
    chosen = marked.join(F.broadcast(least), "mark", "left_semi")  # texts stay where they are, copies too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for mark, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                graph = build_graph(text)
                if len(graph):
                    labels = node_labels(graph, *base_spans(text))[:doc_nodes]
                    for i in np.flatnonzero(labels == 0):
                        labels[i] = -1 if len(w := text[slice(*graph.spans[i])]) >= 12 and secret_value(w) else 0
                    inside = lambda e: e[(e < doc_nodes).all(axis=1)].astype(np.int32).tobytes()
                    out.append((mark, np.packbits(graph.features[:doc_nodes]).tobytes(), labels.astype(np.int8).tobytes(), inside(graph.chain), inside(graph.skip)))
            columns = zip(*out, strict=True) if out else ([], [], [], [], [])
            kinds = (pa.int64(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["mark", "x", "y", "chain", "skip"])

    rows = chosen.mapInArrow(run, "mark long, x binary, y binary, chain binary, skip binary").dropDuplicates(["mark"]).collect()
    graphs, labels = [], []
    for row in sorted(rows):
        y = np.frombuffer(row["y"], dtype=np.int8).astype(np.int64)
        x = np.unpackbits(np.frombuffer(row["x"], dtype=np.uint8), count=len(y) * WIDTH).reshape(-1, WIDTH)
        edges = [np.frombuffer(row[c], dtype=np.int32).astype(np.int64).reshape(-1, 2) for c in ("chain", "skip")]
        graphs.append(Graph([(0, 0)] * len(y), x, *edges))
        labels.append(y)
    for graph, truth in made_up(made, seed):
        if len(graph):
            graphs.append(graph)
            labels.append(truth)
    return fit(joined(graphs), np.concatenate(labels))


def secret_value(token: str) -> tuple[int, int] | None:
    """Where the secret's value lies in a token: behind an assignment if there is one, letters and digits mixed."""
    front = m.end() if (m := _ASSIGNED.match(token)) else 0
    value = token[front:].strip(_TRIM)
    start = token.index(value, front)
    return (start, start + len(value)) if _VALUE.fullmatch(value) else None


def fits(piece: str, kind: int) -> bool:
    """Whether the piece could be of its kind as a whole."""
    if kind == SECRET:
        return secret_value(piece) is not None
    if kind < 2:
        return (0, len(piece), kind) in base_spans(piece)[0]
    return not any(c.isalpha() for c in piece) and (is_card(piece) if kind == 2 else is_phone(piece))


def pieces(text: str, graph: Graph, first: int, last: int, kind: int) -> list[tuple[int, int]]:
    """Tokens first to last cut into pieces (a, b) that fit the kind: the most tokens, then the fewest pieces.

    A plus sign begins a piece. Pieces have at most 19 digits, so only a few ends of each begin are tried.
    """
    best: list[tuple[int, int, int | None]] = [(0, 0, None)]  # covered, -pieces, way back
    for j in range(first, last + 1):
        found = (best[-1][0], best[-1][1], None)
        for i in range(j, max(first, j - 18) - 1, -1):
            piece = text[graph.spans[i][0] : graph.spans[j][1]]
            if len(digits(piece)) > 19 or "+" in text[graph.spans[i][0] + 1 : graph.spans[j][1]]:
                break
            before = best[i - first]
            if fits(piece, kind) and (before[0] + j - i + 1, before[1] - 1) > found[:2]:
                found = (before[0] + j - i + 1, before[1] - 1, i)
        best.append(found)
    out, j = [], last
    while j >= first:
        i = best[j - first + 1][2]
        if i is not None:
            out.append((i, j))
        j = j - 1 if i is None else i - 1
    return out[::-1]


def repeats(piece: str, kind: int) -> bool:
    """Whether a token that a skip edge joins to a span of the kind could be its repeat: the last seven digits are the edge's key."""
    if kind == SECRET:
        return secret_value(piece) is not None
    return "@" in piece if kind == 0 else not any(c.isalpha() for c in piece) and 7 <= len(digits(piece)) <= 19


def added_spans(text: str, graph: Graph, marginals: np.ndarray, base: list[tuple[int, int, int]], sure: float, joined_sure: float = 0.5) -> list[tuple[int, int, int]]:
    """Tokens that the field labels surely, that touch no base span and could be of their kind.

    A token that skip edges join to a span of its label, in whatever form, is sure from joined_sure on: its label comes
    from that span, and its own features need not tell it.

    Neighbouring card and phone tokens are cut into pieces that pass a card's check sum or have a phone's 9 to 15
    digits: first inside each line, then, of what is left, across lines. Addresses have their form, secrets mix
    letters and digits; of an assignment the value alone is the span. A token
    that skip edges join to a span of its label needs the weaker form of a repeat only.
    """
    n = len(graph)
    best, p = marginals.argmax(axis=1), marginals.max(axis=1)
    linked = set(graph.chain[:, 0].tolist())
    covered = np.zeros(n, dtype=np.int64)  # label of the span that a token lies in
    ends = [e for _, e in graph.spans]
    for start, end, kind in base:
        i = bisect_right(ends, start)
        while i < n and graph.spans[i][0] < end:
            covered[i] = covered[i] or kind + 1
            i += 1
    out: list[tuple[int, int, int]] = []

    def take(a: int, b: int, kind: int) -> None:
        start, end = graph.spans[a][0], graph.spans[b][1]
        if kind == SECRET:
            start, end = (start + x for x in secret_value(text[start:end]))
        out.append((start, end, kind))
        covered[a : b + 1] = kind + 1

    def enough() -> np.ndarray:
        """The marginal that each token needs."""
        need = np.full(n, sure)
        for a, b in ((graph.skip[:, 0], graph.skip[:, 1]), (graph.skip[:, 1], graph.skip[:, 0])):
            need[b[(covered[a] > 0) & (covered[a] == best[b])]] = joined_sure
        return need

    def runs(lines: bool) -> list[tuple[int, int]]:
        """Runs of free neighbours of one sure label, inside a line or across lines."""
        free, found, i = (best > 0) & (p >= enough()) & (covered == 0), [], 0
        while i < n:
            j = i
            while free[i] and j + 1 < n and j in linked and free[j + 1] and best[j + 1] == best[i]:
                if lines and any(c in "\r\n" for c in text[graph.spans[j][1] : graph.spans[j + 1][0]]):
                    break
                j += 1
            if free[i]:
                found.append((i, j))
            i = j + 1
        return found

    for lines in (True, True, False):  # the second time with what the first has made known
        for i, j in runs(lines):
            kind = int(best[i]) - 1
            if kind in (2, 3):
                for a, b in pieces(text, graph, i, j, kind):
                    take(a, b, kind)
            elif lines:
                for a in range(i, j + 1):
                    if fits(text[slice(*graph.spans[a])], kind):
                        take(a, a, kind)
    edges = graph.skip.tolist()
    for a, b in [*edges, *((b, a) for a, b in reversed(edges))]:
        if covered[a] and not covered[b] and best[b] == covered[a] and p[b] >= joined_sure and repeats(text[slice(*graph.spans[b])], int(best[b]) - 1):
            take(b, b, int(best[b]) - 1)
    return sorted(out)


def marked_spans(texts: list[str], field: Field, sure: float, most_nodes: int) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text. Graphs pass messages together up to most_nodes nodes; a larger one does alone."""
    out: list[tuple[list, list]] = [([], []) for _ in texts]
    held: list[tuple[int, Graph]] = []

    def settle() -> None:
        if held:
            sizes = [len(g) for _, g in held]
            marginals, _ = field.infer(joined([g for _, g in held]), owner=np.repeat(np.arange(len(held)), sizes))
            at = 0
            for (k, graph), size in zip(held, sizes, strict=True):
                out[k][1].extend(added_spans(texts[k], graph, marginals[at : at + size], out[k][0], sure))
                at += size
            held.clear()

    for k, text in enumerate(texts):
        if _MARK.search(text):
            out[k][0].extend(base_spans(text)[0])
            graph = build_graph(text)
            if sum(len(g) for _, g in held) + len(graph) > most_nodes:
                settle()
            if len(graph):
                held.append((k, graph))
    settle()
    return out


def find_spans(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.9, most_nodes: int = 16_384) -> DataFrame:
    """(doc_id, starts, ends, kinds, added): base spans of each text and those that the field adds, secrets among them.

    One Arrow pass without a shuffle; whole texts. Graphs pass messages together, up to most_nodes nodes at a time.
    Base spans always stay; offsets count code points, ends are exclusive; spans are ordered by start, then kind.

    Cases: a null or empty text has no spans; very long texts take time and memory in proportion to their length;
    repeated rows come back each; null ids are kept; an empty table gives no rows; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = marked_spans([x.as_py() or "" for x in batch.column(1)], field, sure, most_nodes)
            spans = [sorted([*((*s, False) for s in b), *((*s, True) for s in m)], key=lambda s: (s[0], s[2])) for b, m in found]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            lists = [pa.array([[s[k] for s in row] for row in spans], pa.list_(kind)) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "starts", "ends", "kinds", "added"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, starts array<long>, ends array<long>, kinds array<int>, added array<boolean>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of find_spans: those of the contract are of base spans, the others of all spans."""
    names = F.array(*[F.lit(k) for k in SPAN_KINDS])
    each = F.transform(
        F.arrays_zip("starts", "ends", "kinds", "added"),
        lambda s: F.struct(
            F.concat_ws(":", F.element_at(names, s["kinds"] + 1), s["starts"].cast("string"), s["ends"].cast("string")).alias("text"), s["added"].alias("added")
        ),
    )
    texts = lambda spans: F.array_join(F.transform(spans, lambda s: s["text"]), ",")
    count = lambda k: F.size(F.filter(F.arrays_zip("kinds", "added"), lambda s: (s["kinds"] == k) & ~s["added"])).cast("long")
    return found.withColumn("_each", each).select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(texts(F.filter("_each", lambda s: ~s["added"])), 256).alias("base_sha256"),
        texts(F.col("_each")).alias("spans"),
        F.size(F.filter("kinds", lambda k: k == SECRET)).cast("long").alias("n_secret"),
        F.size(F.filter("added", lambda a: a)).cast("long").alias("n_added"),
        F.size("kinds").cast("long").alias("n_spans"),
        (F.size("kinds") > 0).alias("flagged"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(find_spans(docs, train(docs)))
