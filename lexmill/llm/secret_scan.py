"""Secret scans: base rules and a character convolutional network over every candidate and its surrounding context.

Candidates are all base findings, runs of 16 or more key characters (dots among them) with a letter or digit, of a run that base
spans cover in part also the parts of 16 or more characters outside them, and values of 6 or more characters behind words such as
password. The network (numpy) reads the characters around and in a candidate and says how likely it is a secret. Every
candidate is scored; base findings stay whatever their score, and candidates that they don't cover become spans of kind
`model` from the threshold on (a run first as a whole, or else its parts). Findings of the network may overlap base ones.

The network is fitted on labelled findings: seeded, generated ones, and a bounded sample of those of a table (`fit`), where base
findings are secrets and other runs are not; at most REAL of each, of distinct context. A part of both kinds calibrates the logits,
and a third part sets the thresholds, one for candidates under 16 characters and one for the others: the greatest that find
RECALL of the secrets of either origin, where a secret without a candidate counts as missed, and from there half the way down
to the next finding that is no secret.

Null text is empty: no findings; `redact` leaves a null text null. Texts of any length are read whole, candidates of any
length in windows of which the likeliest counts, a bounded number at a time. Findings that start together are ordered by
kind: assign, access, hex, model. Rows that repeat give equal rows; an empty table gives none, and its fit has generated findings only.
Extra columns are not read; `redact` returns them.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, documents

# The base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "model")

RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")
VALUE = re.compile(r"""(?:(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_\x20-]?key|credentials?|auth(?:orization)?)["']?\x20*[:=]\x20*["']?|bearer\x20+)(?!(?:bearer|basic|pass(?:word|wd|phrase)|secret|token)\b)([^\s"'<>,;]{6,})""", re.IGNORECASE | re.ASCII)
VALUE_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
SHORTEST, SHORTEST_VALUE = 16, 6
LEFT, INNER, RIGHT = 24, 56, 16
WIDTH = LEFT + INNER + RIGHT
CODES, DEPTH, REACH, FILTERS = 98, 8, 5, 24
EXAMPLES, EPOCHS, BATCH, RECALL, SEED = 6000, 12, 64, 0.97, 11
#: Of a table: labelled findings of each label to learn from, and the rows they are taken from.
REAL, REAL_ROWS = 1000, 20_000
#: Windows that the network reads at once, and rows whose candidates it reads together.
WINDOWS, ROWS = 1024, 500

Span = tuple[int, int, str]


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """Spans of the base rules, by start and kind; a run of hexadecimal digits of 16 or more lies in a run of key characters."""
    found: list[Span] = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for a, b in runs for m in HEX.finditer(text, a, b)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def runs_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in RUN.finditer(text)]


def _tail(text: str, start: int, end: int, marks: str) -> int:
    while end > start and text[end - 1] in marks:
        end -= 1
    return end


def _wholes(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs without a full stop at the end, and values behind key words that lie in no run."""
    found = [(a, e) for a, b in runs if (e := _tail(text, a, b, ".")) - a >= SHORTEST and any(map(str.isalnum, text[a:e]))]
    lower = text.lower()
    if any(w in lower for w in VALUE_WORDS):
        starts = [a for a, _ in runs]
        for m in VALUE.finditer(text):
            a, e = m.start(1), _tail(text, m.start(1), m.end(1), ".:!?)]}|")
            k = bisect.bisect_right(starts, a) - 1
            if e - a >= SHORTEST_VALUE and not (k >= 0 and runs[k][1] >= e) and any(map(str.isalnum, text[a:e])):
                found.append((a, e))
    return sorted(found)


def candidates(text: str, runs: list[tuple[int, int]], base: list[Span]) -> Iterator[list[tuple[int, int]]]:
    """For each run or value that base spans don't cover: all of it, then the parts outside them that are long enough, if these are others."""
    first = 0
    for a, b in _wholes(text, runs):
        while first < len(base) and base[first][1] <= a:
            first += 1
        parts, at = [], a
        for s, e, _ in itertools.islice(base, first, None):
            if s >= b:
                break
            if e > at:
                if s > at:
                    parts.append((at, s))
                at = max(at, min(e, b))
        if at < b:
            parts.append((at, b))
        if parts:
            yield [(a, b)] + [(s, e) for s, e in parts if e - s >= SHORTEST and (s, e) != (a, b) and any(map(str.isalnum, text[s:e]))]


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


#: The code of each character below 127; 95 is white space, 96 any other character, 97 nothing.
_CODES = np.array([c - 32 if 32 <= c <= 126 else 95 if chr(c).isspace() else 96 for c in range(127)], np.uint8)
_SPACES = np.array([c for c in range(127, 0x3001) if chr(c).isspace()], np.uint32)


def windows(text: str, start: int, end: int) -> Iterator[np.ndarray]:
    """Character codes and, in a second plane, whether they belong to the candidate; a row for each window of it, WINDOWS of them at once."""
    points = np.frombuffer(text[max(0, start - LEFT) : end + RIGHT].encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < 127, _CODES[np.minimum(points, 126)], np.where(np.isin(points, _SPACES), 95, 96)).astype(np.uint8)
    line = np.concatenate((np.full(max(0, LEFT - start), 97, np.uint8), codes, np.full(WIDTH, 97, np.uint8)))
    number = -(-(end - start) // INNER)
    views = np.lib.stride_tricks.sliding_window_view(line, WIDTH)[::INNER]
    place = np.arange(WIDTH) - LEFT
    for first in range(0, number, WINDOWS):
        part = views[first : min(first + WINDOWS, number)]
        left = end - start - INNER * np.arange(first, first + len(part))
        yield np.stack((part, (place >= 0) & (place < np.minimum(left, INNER)[:, None])), 1)


@dataclass
class Network:
    """Embedding, one convolution, the maximum and the candidate's mean of each filter, and a logit; then calibration."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    #: For candidates of SHORTEST characters and more, and for shorter ones.
    threshold: float = 0.5
    short_threshold: float = 0.5

    def accepts(self, length: int, chance: float) -> bool:
        return chance >= (self.threshold if length >= SHORTEST else self.short_threshold)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        planes = np.concatenate((self.embed[x[:, 0]], x[:, 1, :, None].astype(np.float32)), 2)
        return np.lib.stride_tricks.sliding_window_view(planes, REACH, 1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - REACH + 1, REACH * (DEPTH + 1))

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        columns = self._columns(x)
        active = np.maximum(columns @ self.kernel + self.bias, 0)
        inside = x[:, 1, REACH // 2 : WIDTH - REACH // 2].astype(np.float32)
        share = inside / np.maximum(1, inside.sum(1, keepdims=True))
        pooled = np.concatenate((active.max(1), (active * share[:, :, None]).sum(1)), 1)
        return pooled @ self.head + self.offset, (columns, active, share, pooled)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.forward(x)[0] + self.shift, -40, 40)))

    def scores(self, places: Iterable[tuple[str, int, int]]) -> np.ndarray:
        """For each candidate (text, start, end) the greatest probability of its windows."""
        best, held, owners, size = [], [], [], 0

        def read() -> None:
            nonlocal size
            if held:
                chances = self.probability(np.concatenate(held))
                for owner, chance in zip(np.concatenate(owners).tolist(), chances.tolist()):
                    best[owner] = max(best[owner], chance)
            held.clear()
            owners.clear()
            size = 0

        for text, start, end in places:
            best.append(0.0)
            for part in windows(text, start, end):
                held.append(part)
                owners.append(np.full(len(part), len(best) - 1))
                size += len(part)
                if size >= WINDOWS:
                    read()
        read()
        return np.array(best)


def generated(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of n findings: secrets of several makes, and lookalikes, each in a context."""
    return labelled(n, seed)[:2]


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """generated(n, seed), and how many secrets drawn on the way gave neither a candidate nor a base span that covers them."""
    draw = np.random.default_rng(seed)
    pick = lambda kinds: kinds[draw.integers(len(kinds))]
    of = lambda letters, a, b: "".join(letters[i] for i in draw.integers(0, len(letters), draw.integers(a, b)))
    low, up, num = string.ascii_lowercase, string.ascii_uppercase, string.digits
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ti", "to", "it", "st", "ou", "ment", "que", "ung", "sch", "ción", "pf", "tz", "ck", "keit", "lich", "ver", "zu", "be", "ge", "heit", "eau", "oux", "dad"]
    word = lambda a, b: "".join(pick(syllables) for _ in range(draw.integers(a, b)))
    prose = lambda: " ".join(word(1, 4) for _ in range(draw.integers(2, 7)))

    def secret() -> str:
        kind = draw.integers(12)
        if kind == 8:
            return ".".join(of(low + up + num + "-_", a, b) for a, b in ((18, 40), (24, 80), (20, 44)))
        if kind == 11 and draw.integers(2):
            return pick(["password: ", "Password=", "pwd: ", "secret = ", "auth: "]) + word(1, 4) + pick(["", "!", "_", "@"]) + of(num, 2, 5)
        if kind in (9, 11):
            return pick(["password: ", "Password=", "pwd: ", "secret = ", "token=", "api key: ", "auth: "]) + of(low + up + num + "!@#$%&*?", 7, 12)
        if kind == 10:
            return "-----BEGIN PRIVATE KEY-----" + chr(10) + of(low + up + num + "+/", 64, 65)
        if kind == 0:
            return of("0123456789ABCDEF", 24, 65)
        if kind == 1:
            return of("0123456789abcdef", 12, 33) + of("ghijk0123456789", 6, 12)
        if kind == 2:
            return of(low + up + num + "+/", 20, 80) + pick(["", "=", "=="])
        if kind == 3:
            return pick(["ghp_", "sk_live_", "xoxb-", "AIza", "glpat-", "key-"]) + of(low + up + num, 20, 44)
        if kind == 4:
            return of(low + up + num + "-_", 24, 64)
        if kind == 5:
            return of(up + num, 20, 40)
        if kind == 6:
            return of(low + up, 20, 48)
        return of(low + num, 20, 48)

    def lookalike() -> str:
        kind = min(draw.integers(19), 16)
        if kind == 12:
            return pick(["", "", f"{of(num, 1, 4)}@mail"]) + ".".join(word(1, 3).replace("ó", "o") for _ in range(draw.integers(2, 4))) + pick([".example.com", f"{of(num, 1, 2)}.example.org", ".tar.gz", ".html"])
        if kind in (13, 16):
            return pick(["password: ", "Password = ", "token: ", "secret: ", "api key: "]) + pick([word(3, 6), word(3, 6), pick(["required", "expired", "please enter", "unknown", "invalid", "optional", "incorrect", "changed", "missing", "yesterday"])])
        if kind == 14:
            return ".".join(of(num, 1, 4) for _ in range(4)) + "-" + of(num, 5, 9)
        if kind == 15:
            return "//".join(("https:", word(2, 4).replace("ó", "o"))) + ".example.com/" + "/".join(word(1, 4).replace("ó", "o") for _ in range(draw.integers(2, 4)))
        if kind == 0:
            return word(5, 9).replace("ó", "o") + of(num, 1, 5)
        if kind == 1:
            return "_".join(word(1, 3).replace("ó", "o") for _ in range(draw.integers(3, 6))) + "_" + of(num, 1, 4)
        if kind == 2:
            return f"{of('12', 1, 2)}0{of(num, 2, 3)}-0{of('123456789', 1, 2)}-1{of(num, 1, 2)}T{of(num, 2, 3)}-{of(num, 2, 3)}-{of(num, 2, 3)}"
        if kind == 3:
            return "/".join(word(1, 3).replace("ó", "o") for _ in range(draw.integers(3, 6))) + "/" + of(num, 1, 6)
        if kind == 4:
            return pick(["-", "=", "_", "+"]) * int(draw.integers(14, 40)) + pick(low) + of(num, 1, 2)
        if kind == 5:
            return "".join(word(1, 3).replace("ó", "o").capitalize() for _ in range(draw.integers(4, 7))) + of(num, 1, 3)
        if kind == 6:
            return word(2, 4).replace("ó", "o") + "-" + of(num, 2, 4) + "-" + word(2, 5).replace("ó", "o") + "-" + of(num, 1, 4)
        if kind == 7:
            return pick([str.lower, str.lower, str.upper])(word(6, 12).replace("ó", "o"))
        if kind == 8:
            return pick(["-", "_", "/"]).join(word(1, 4).replace("ó", "o") for _ in range(draw.integers(4, 7)))
        if kind == 9:
            return "".join(word(1, 3).replace("ó", "o").capitalize() for _ in range(draw.integers(5, 8)))
        if kind == 10:
            return "-".join(of(num, 2, 5) for _ in range(draw.integers(5, 8)))
        return word(1, 2).replace("ó", "o").upper() + "-" + of(num, 4, 6) + "-" + of(num, 4, 6) + "-" + of(num, 4, 6)

    rows, labels, missed = [], [], 0
    while len(rows) < n:
        positive = bool(draw.integers(2))
        value = secret() if positive else lookalike()
        before = pick(["", "key ", "id: ", "auth=", "Bearer ", "pass: ", "see ", "ref ", "x = \"", "(", "http://a.example/"]) if draw.random() < 0.5 else ""
        text = f"{prose()}{pick([' ', '. ', chr(10)])}{before}{value}{pick([' ', '. ', ', ', '\" ', ')'])}{prose()}"
        at = text.index(value)
        runs = runs_of(text)
        base = base_spans(text, runs)
        over = lambda s, e: s < at + len(value) and at < e
        hits = [whole for whole, *_ in candidates(text, runs, base) if over(*whole)] or [(s, e) for s, e, _ in base if positive and over(s, e)]
        if hits:
            rows.append(next(windows(text, *hits[-1]))[0])
            labels.append(positive)
        elif positive:
            missed += 1
    return np.stack(rows), np.array(labels, np.float32), missed


def table_findings(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of findings in docs, at most REAL of each label: base findings, and runs and values beside them.

    They come from about REAL_ROWS rows, those with the least hashes of doc_id and text, in an order that the content gives.
    """
    rows = docs.filter(F.col("text").isNotNull()).select("text", F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("rank"))
    share = min(1.0, REAL_ROWS / max(1, rows.count()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0):
                text = text.as_py()
                runs = runs_of(text)
                base = base_spans(text, runs)
                found = [(s, e, True) for s, e, _ in base] + [(*whole, False) for whole, *_ in candidates(text, runs, base) if not any(s < whole[1] and whole[0] < e for s, e, _ in base)]
                for s, e, label in found:
                    window = next(windows(text, s, e))[0].tobytes()
                    out.append((label, xxhash.xxh64_intdigest(window) >> 1, window))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 3, (pa.bool_(), pa.int64(), pa.binary()))], names=["label", "rank", "x"])

    found = rows.filter(F.col("rank") <= F.lit(int(share * 2**64 - 2**63) if share < 1 else 2**63 - 1)).select("text").mapInArrow(each, "label boolean, rank bigint, x binary")
    found = checkpoint(found.dropDuplicates(["label", "rank"]))
    x, y = [np.empty((0, 2, WIDTH), np.uint8)], []
    for label in (False, True):
        for row in found.filter(F.col("label") == label).orderBy("rank", "x").limit(REAL).collect():
            x.append(np.frombuffer(row["x"], np.uint8).reshape(1, 2, WIDTH))
            y.append(label)
    return np.concatenate(x), np.array(y, np.float32)


def fit(docs: DataFrame) -> Network:
    """The network for a table: fitted on generated findings and on a bounded sample of the table's own."""
    return train(*table_findings(docs))


@functools.lru_cache(maxsize=1)
def trained() -> Network:
    """The network of generated findings alone."""
    return train(np.empty((0, 2, WIDTH), np.uint8), np.empty(0, np.float32))


def train(real_x: np.ndarray, real_y: np.ndarray) -> Network:
    """Fit, calibrate and set the threshold; the same network for the same findings. Of the real ones two in four fit, one calibrates, one sets the threshold."""
    turn = np.arange(len(real_y)) % 4
    draw = np.random.default_rng(SEED)
    size = (DEPTH + 1) * REACH
    net = Network(
        draw.normal(0, 0.5, (CODES, DEPTH)).astype(np.float32), draw.normal(0, size**-0.5, (size, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), draw.normal(0, 0.2, 2 * FILTERS).astype(np.float32), 0.0,
    )
    x, y = generated(EXAMPLES, SEED)
    x, y = np.concatenate((x, real_x[turn < 2])), np.concatenate((y, real_y[turn < 2]))
    names = ("embed", "kernel", "bias", "head", "offset")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    for _ in range(EPOCHS):
        for at in np.array_split(draw.permutation(len(x)), len(x) // BATCH):
            logit, (columns, active, share, pooled) = net.forward(x[at])
            pull = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[at]) / len(at)
            back = pull[:, None] * net.head[None]
            grow = np.zeros_like(active)
            np.put_along_axis(grow, active.argmax(1)[:, None], back[:, None, :FILTERS], 1)
            grow = (grow + share[:, :, None] * back[:, None, FILTERS:]) * (active > 0)
            flat = grow.reshape(-1, FILTERS)
            planes = (grow @ net.kernel.T).reshape(len(at), -1, REACH, DEPTH + 1)
            embed = np.zeros_like(net.embed)
            for k in range(REACH):
                np.add.at(embed, x[at, 0, k : k + planes.shape[1]], planes[:, :, k, :DEPTH])
            slopes = {"embed": embed, "kernel": columns.reshape(-1, size).T @ flat, "bias": flat.sum(0), "head": pooled.T @ pull, "offset": pull.sum()}
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * slopes[k]
                second[k] = 0.999 * second[k] + 0.001 * slopes[k] ** 2
                move = 0.005 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - move).astype(np.float32))
    x, y = generated(EXAMPLES // 3, SEED + 1)
    x, y = np.concatenate((x, real_x[turn == 2])), np.concatenate((y, real_y[turn == 2]))
    logit = net.forward(x)[0].astype(np.float64)
    scale, shift = 1.0, 0.0
    for _ in range(300):
        off = 1 / (1 + np.exp(-np.clip(scale * logit + shift, -40, 40))) - y
        scale, shift = scale - 0.05 * float((off * logit).mean()), shift - 0.05 * float(off.mean())
    net.scale, net.shift = max(scale, 1e-3), shift
    x, y, missed = labelled(EXAMPLES // 2, SEED + 2)
    kept_x, kept_y = real_x[turn == 3], real_y[turn == 3]
    others = np.concatenate((x[y == 0], kept_x[kept_y == 0]))
    net.threshold = net.short_threshold = 1.0
    for name, of_size in (("threshold", lambda part: part[:, 1].sum(1) >= SHORTEST), ("short_threshold", lambda part: part[:, 1].sum(1) < SHORTEST)):
        for secrets, lost in ((x[y == 1], missed), (kept_x[kept_y == 1], 0)):
            found = np.sort(net.probability(secrets[of_size(secrets)]))
            if len(found):
                setattr(net, name, min(getattr(net, name), float(found[max(0, int((1 - RECALL) * (len(found) + lost)) - lost)])))
        below = net.probability(others[of_size(others)])
        below = below[below < getattr(net, name)]
        setattr(net, name, (getattr(net, name) + float(below.max(initial=0.0))) / 2)
    return net


Scored = tuple[list[Span], list[Span], list[tuple[int, int, str, float]]]


def findings(texts: list[str], net: Network) -> list[Scored]:
    """For each text its base spans, all spans in order, and each candidate with its score: base findings by kind, others as `model`."""
    plans, places = [], []
    for text in texts:
        runs = runs_of(text)
        base = base_spans(text, runs)
        groups = list(candidates(text, runs, base))
        plans.append((base, groups))
        places += [(text, s, e) for s, e, _ in base] + [(text, s, e) for group in groups for s, e in group]
    scores, at, out = net.scores(places).tolist(), 0, []
    for base, groups in plans:
        scored = [(s, e, kind, scores[at + k]) for k, (s, e, kind) in enumerate(base)]
        at += len(base)
        more: list[Span] = []
        for group in groups:
            own = scores[at : at + len(group)]
            at += len(group)
            scored += [(s, e, "model", p) for (s, e), p in zip(group, own)]
            good = [(s, e, "model") for (s, e), p in zip(group, own) if net.accepts(e - s, p)]
            more += good[:1] if good and good[0][:2] == group[0] else good
        order = lambda x: (x[0], KINDS.index(x[2]), x[1])
        out.append((base, sorted(base + more, key=order), sorted(scored, key=order)))
    return out


def find(text: str, net: Network) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans in order."""
    return findings([text], net)[0][:2]


FINDINGS = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_model bigint, n_candidates bigint, scores string"


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """A row for each row of docs: findings by kind, the digest of the base spans, all spans, and the score of every candidate."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FINDINGS.split(", ")]
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()]
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part, out = batch.slice(first, ROWS), []
                found = findings([t or "" for t in part.column(1).to_pylist()], net)
                for doc, (base, spans, scored) in zip(part.column(0).to_pylist(), found):
                    n = {k: sum(s[2] == k for s in spans) for k in KINDS}
                    scores = ",".join(f"{kind}:{s}:{e}:{p:.3f}" for s, e, kind, p in scored)
                    out.append((doc, n["assign"], n["access"], n["hex"], hashlib.sha256(written(base).encode()).hexdigest(), written(spans), n["model"], len(scored), scores))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"]).mapInArrow(rows, FINDINGS)


def _marked(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if start > at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(text: str, net: Network, mark: str = "[SECRET]") -> str:
    """text with each finding, or findings that touch, replaced by mark."""
    return _marked(text, find(text, net)[1], mark)


def redact(docs: DataFrame, net: Network, mark: str = "[SECRET]") -> DataFrame:
    """docs with the findings in text replaced; a column n_chars follows the new text."""

    @F.pandas_udf("string")
    def clean(texts):
        out = []
        for first in range(0, len(texts), ROWS):
            part = texts.iloc[first : first + ROWS].tolist()
            found = findings([t or "" for t in part], net)
            out += [None if t is None else _marked(t, spans, mark) for t, (_, spans, _) in zip(part, found)]
        return texts.__class__(out, dtype=object)

    new = docs.withColumn("text", clean(docs["text"]))
    if "n_chars" not in docs.columns:
        return new
    return new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan(docs, fit(docs))
