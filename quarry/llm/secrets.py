"""Secret scans: rules for known forms, and character Markov models for random strings.

Rules find assignments, access keys and long hexadecimal runs. Beside them, every run of 16 or more characters of
``[A-Za-z0-9_+/=-]`` is scored by two second-order character models, one of random strings and one of ordinary identifiers:
where the mean log-likelihood ratio a character reaches the threshold, the run is a span of kind ``markov``. Of other runs
the best stretches of 16 characters or more between signs of equality are taken, so that a name or path in front doesn't
outweigh a secret: one that reaches a threshold of its own is a span, with the whole of the words at its ends. What a rule's
span covers is cut out of a run first. Both models are trained, once and on the driver, on labelled samples made by rule from
a seed. Each mix of small letters, capitals and digits has its thresholds, between the scores of ordinary samples held out
(for stretches, also names and paths put together from these), none of which is flagged, and those of random ones. Numbers, dates, lines of one character and
sequences count as ordinary, so that a random number alone is no secret.

A null or empty text has no spans; texts of any length are scanned whole. Offsets count code points. Rows are independent:
any column may be null, rows may repeat, extra columns are ignored (``redact`` keeps them), and an empty table gives an empty
result. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, parts

KINDS = ("assign", "access", "hex", "markov")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32, "run": 16}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=-"
RUN = re.compile(rb"[A-Za-z0-9_+/=-]{16,}")
#: What a run has between the signs of equality, and what stands between the words of a name or path.
PIECE, BETWEEN = re.compile(rb"[^=]{16,}"), b"/_-+"
SMALL, CAPITAL, DIGIT = re.compile(rb"[a-z]"), re.compile(rb"[A-Z]"), re.compile(rb"[0-9]")
MARGIN, SMOOTH, SAMPLES, SEED = 0.1, 0.05, 12_000, 20240
#: What ordinary identifiers are made of.
STEMS = (
    "get set make read write open close find list load store send fetch build check count sort merge split join group filter map reduce update delete insert select create remove append "
    "user name file path line text word page table row column index key value item node tree graph list array buffer stream block chunk batch queue stack cache session request response "
    "server client host port socket thread process task worker manager handler service factory builder parser reader writer version config option default number string integer double boolean "
    "date time start end begin first last next previous total average minimum maximum length size width height color image document report account customer order product payment address "
    "the and that with from this have which their would there about other these between through international management development information communication"
).split()


#: Parts of the syllables of words that no list has.
ONSETS, NUCLEI, CODAS = "b c ch d f g h j k l m n p ph qu r s sch sh sp st t th tr v w wh z br cl pr gr bl cr dr fl fr gl gn kl kn kr pf pl schw str x y zw".split(), "a e i o u ai au ea ee ei eu ie io oo ou ae eau ia oe oi ue ui y".split(), ["", "", "", *"n r s t l nd ng nt rs st ll ble tion ment ch ly m d ck rt lt cht ft keit k lich ns p pf rk sch ss th tz ung x z".split()]


def made_up(rng: random.Random) -> str:
    return "".join(rng.choice(ONSETS) * (rng.random() < 0.85) + rng.choice(NUCLEI) + rng.choice(CODAS) for _ in range(rng.randint(1, 6)))


def number_like(rng: random.Random) -> str:
    """Numbers, dates, ranges, rulers and sequences, as texts and tables have them."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind, sign = rng.randrange(6), rng.choice("-_/=+")
    if kind == 0:
        return digits(rng.randint(16, 30))
    if kind == 1:
        return rng.choice("-_/").join(digits(rng.choice((2, 3, 4))) for _ in range(rng.randint(4, 8)))
    if kind == 2:
        return rng.choice(ALPHABET) * rng.randint(16, 80)
    if kind == 3:
        return rng.choice(("ab", "xo", "ha", "na", "10", "-=", "+-", "_-", "xX", "abc", "123", "la")) * rng.randint(8, 20)
    if kind == 4:
        line = rng.choice(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "qwertyuiopasdfghjklzxcvbnm", "01234567890123456789"))
        return (line * 2)[rng.randrange(5) :][: rng.randint(16, 40)]
    return sign.join(rng.choice(STEMS) + digits(rng.randint(0, 4)) for _ in range(rng.randint(2, 6)))


def ordinary_samples(rng: random.Random, n: int) -> list[str]:
    """Identifiers as people write them: words joined in the usual ways, some with a number at the end; and what is like numbers."""
    out = []
    while len(out) < n:
        w = [rng.choice(STEMS) if rng.random() < 0.5 else made_up(rng) for _ in range(rng.randint(1, 5))]
        style = rng.randrange(9)
        text = (
            "_".join(w), "-".join(w), "/".join(w), w[0] + "".join(x.title() for x in w[1:]), "".join(x.title() for x in w), "_".join(w).upper(), "".join(w), "".join(w).upper(), number_like(rng),
        )[style]
        if style < 6:
            text += rng.choice(("", "", "1", "2", "_v2", "10", "_2024", "-2023-11", "_test", "64", "_utf8"))
        if len(text) >= LEAST["run"]:
            out.append(text)
    return out


def joined_samples(rng: random.Random, names: list[str], n: int) -> list[str]:
    """Paths, keys and assignments put together from ordinary identifiers."""
    return ["=".join(rng.choice("/_-").join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 2))) for _ in range(n)]


def random_samples(rng: random.Random, n: int) -> list[str]:
    """Draws from the alphabets of keys, digests and passwords."""
    kinds = (ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "_-", "0123456789abcdef", ALPHABET[26:62], ALPHABET[:26] + "0123456789", ALPHABET[:26], ALPHABET[26:52], ALPHABET[:52])
    return ["".join(rng.choice(a) for _ in range(rng.randint(16, 48))) for a in (rng.choice(kinds) for _ in range(n))]


class Model:
    """Probability of a character after the two before it, smoothed by the shorter contexts."""

    def __init__(self, samples: list[str]) -> None:
        n = len(ALPHABET)
        one, two, three = np.zeros(n), np.zeros((n + 1, n)), np.zeros((n + 1, n + 1, n))
        for s in samples:
            a = b = n
            for c in s:
                k = ALPHABET.index(c)
                one[k] += 1
                two[b, k] += 1
                three[a, b, k] += 1
                a, b = b, k
        p1 = (one + 1) / (one.sum() + n)
        p2 = (two + n * SMOOTH * p1) / (two.sum(-1, keepdims=True) + n * SMOOTH)
        self.log = np.log((three + n * SMOOTH * p2[None, :, :]) / (three.sum(-1, keepdims=True) + n * SMOOTH))


MIXES = 8


def mix(run: bytes) -> int:
    """Which of small letters, capitals and digits a run has."""
    return (SMALL.search(run) is not None) + 2 * (CAPITAL.search(run) is not None) + 4 * (DIGIT.search(run) is not None)


class Detector:
    """Both models and their thresholds; small enough to be sent to every task."""

    def __init__(self) -> None:
        rng = random.Random(SEED)
        n = len(ALPHABET)
        kept, held = ordinary_samples(rng, SAMPLES), ordinary_samples(rng, SAMPLES)
        self.ratio = Model(random_samples(rng, SAMPLES)).log - Model(kept).log
        self.code = np.full(256, n, np.int64)
        self.code[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(n)
        drawn = random_samples(rng, SAMPLES)
        whole = lambda texts: [(mix(x), self.score(x)) for x in (s.encode() for s in texts)]

        def in_parts(texts: list[str]) -> list[tuple[int, float]]:
            out = []
            for x in (x for s in texts for x in s.encode().split(b"=") if len(x) >= LEAST["run"]):
                mean, a, b = best(self.ratios(x))
                out.append((mix(x[a:b]), mean))
            return out

        self.threshold = self.over(whole(held), whole(drawn))
        self.part_threshold = self.over(in_parts(held + joined_samples(rng, held, SAMPLES)), in_parts(s[: LEAST["run"]] for s in drawn))
        self.least = min(self.part_threshold)

    @staticmethod
    def over(ordinary: list[tuple[int, float]], drawn: list[tuple[int, float]]) -> list[float]:
        """For each mix of characters, what is above all ordinary scores: halfway to those of random strings, or by MARGIN.

        A mix without any ordinary sample takes what is above the others.
        """
        out = []
        for k in range(MIXES):
            most = max(0.0, max((x for m, x in ordinary if m == k), default=max(x for _, x in ordinary)))
            own = sorted(x for m, x in drawn if m == k)
            least = own[len(own) // 50] if own else most  # but for one in fifty
            out.append(max(most + MARGIN, (most + least) / 2))
        return out

    def ratios(self, run: bytes) -> np.ndarray:
        """Log-likelihood ratio of random to ordinary of each character."""
        k = self.code[np.frombuffer(run, np.uint8)]
        before = np.concatenate(([len(ALPHABET)] * 2, k[:-1]))
        return self.ratio[before[:-1], before[1:], k]

    def score(self, run: bytes) -> float:
        """Mean log-likelihood ratio of random to ordinary, a character."""
        return float(self.ratios(run).mean())

    def random(self, run: bytes) -> bool:
        return self.score(run) >= self.threshold[mix(run)]

    def stretches(self, run: bytes) -> list[tuple[int, int]]:
        """Start and end of what is random in a run: all of it, or its best stretches."""
        if self.random(run):
            return [(0, len(run))]
        out = []
        for m in PIECE.finditer(run):
            x = self.ratios(m[0])
            todo = [(0, len(x))]
            while todo:
                low, high = todo.pop()
                if high - low < LEAST["run"]:
                    continue
                mean, a, b = best(x[low:high])
                if mean < self.least:
                    continue
                a, b = a + low, b + low
                threshold = self.part_threshold[mix(m[0][a:b])]
                if mean < threshold:  # another mix may have less to reach
                    todo += [(low, b - 1), (a + 1, high)] if high - low <= 4 * LEAST["run"] else [(low, a), (b, high)]
                    continue
                more, less = np.cumsum(x[b:high] - threshold), np.cumsum(x[low:a][::-1] - threshold)
                if len(more) and more.max() > 0:
                    b += int(more.argmax()) + 1
                if len(less) and less.max() > 0:
                    a -= int(less.argmax()) + 1
                while a > low and m[0][a] not in BETWEEN and m[0][a - 1] not in BETWEEN:
                    a -= 1
                while b < high and m[0][b - 1] not in BETWEEN and m[0][b] not in BETWEEN:
                    b += 1
                lead = len(m[0][a:b]) - len(m[0][a:b].lstrip(BETWEEN))
                end = m.end() if b == len(x) else m.start() + b
                while b == len(x) and end < len(run) and run[end] == ord("="):  # padding
                    end += 1
                out.append((m.start() + a + lead, end))
                todo += [(low, a), (b, high)]
        return sorted(out)


def best(x: np.ndarray) -> tuple[float, int, int]:
    """The greatest mean of a stretch of LEAST["run"] values or more, its start and end."""
    sums, found = np.concatenate(([0.0], np.cumsum(x))), (-math.inf, 0, 0)
    for n in range(LEAST["run"], min(2 * LEAST["run"], len(x) + 1)):  # a longer one has a part as good
        means = (sums[n:] - sums[:-n]) / n
        k = int(means.argmax())
        found = max(found, (float(means[k]), k, k + n))
    return found


@lru_cache(1)
def detector() -> Detector:
    return Detector()


IN_RUN = np.zeros(256, bool)
IN_RUN[np.frombuffer(ALPHABET.encode(), np.uint8)] = True


def runs(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of LEAST["run"] or more characters of the alphabet; none crosses one of ``ends``."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = IN_RUN[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - start >= LEAST["run"]
    for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True):
        cuts = ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, b, "left")].tolist()
        for x, y in itertools.pairwise([a, *cuts, b]):
            if y - x >= LEAST["run"]:
                yield x, y


def spans_in(text: str, found: list[bytes], at: list[int], models: Detector) -> list[tuple[int, int, str]]:
    """All spans of a text. ``found``: its long runs, at these code points."""
    spans = []
    low = text.lower()
    if any(x in low for x in NAMES):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for run, k in zip(found, at, strict=True):
        s = run.decode()
        spans += [(k + m.start(), k + m.end(), "access") for m in ACCESS.finditer(s) if len(m[0]) >= LEAST["access"]]
        spans += [(k + m.start(), k + m.end(), "hex") for m in HEX.finditer(s) if len(m[0]) >= LEAST["hex"]]
    base = list(spans)
    for run, k in zip(found, at, strict=True):
        done = 0
        for a, b in [*sorted((a - k, b - k) for a, b, _ in base if a < k + len(run) and k < b), (len(run), len(run))]:
            if a - done >= LEAST["run"]:
                spans += [(k + done + x, k + done + y, "markov") for x, y in models.stretches(run[done:a])]
            done = max(done, b)
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


def scan_texts(texts: pa.Array, models: Detector | None = None) -> list[list[tuple[int, int, str]]]:
    """Spans of each text of an Arrow array."""
    models = models or detector()
    strings = texts.cast(pa.large_string()).fill_null("")
    strings = pa.concat_arrays([strings])  # from offset 0
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[: len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[: offsets[-1]] if len(strings) else np.zeros(0, np.uint8)
    by_doc: dict[int, list[tuple[int, int]]] = {}
    for a, b in runs(data, offsets[1:-1]):
        by_doc.setdefault(int(np.searchsorted(offsets, a, "right")) - 1, []).append((a, b))
    out = []
    for i, text in enumerate(strings.to_pylist()):
        found, at, done, chars = by_doc.get(i, ()), [], int(offsets[i]), 0
        for a, _ in found:
            chars += len(data[done:a].tobytes().decode())
            done = a
            at.append(chars)
        out.append(spans_in(text, [data[a:b].tobytes() for a, b in found], at, models))
    return out


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    models = docs.sparkSession.sparkContext.broadcast(detector())  # 2.5 MB

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = scan_texts(batch.column("text"), models.value)
            base = [[s for s in spans if s[2] != "markov"] for spans in found]
            counts = {f"n_{k}": pa.array([sum(s[2] == k for s in spans) for spans in found], pa.int64()) for k in KINDS}
            digest = pa.array([hashlib.sha256(written(s).encode()).hexdigest() for s in base], pa.string())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **counts, "base_sha256": digest, "spans": pa.array([written(s) for s in found], pa.string())})

    return docs.select("doc_id", "text").mapInArrow(report, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


MASK = "[removed]"


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with the values of its secrets replaced; the name in front of an assigned value stays."""
    out, done = [], 0
    for a, b, kind in spans:
        if kind == "assign" and (m := ASSIGN.match(text, a)):
            a = m.start(2)
        if b > done:
            out += [text[done : max(a, done)], MASK]
            done = b
    return "".join(out) + text[done:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret masked and ``n_chars`` counted anew where that column exists."""
    names = docs.columns
    models = docs.sparkSession.sparkContext.broadcast(detector())  # 2.5 MB

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(names.index("text"))
            found = scan_texts(texts, models.value)
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array([t if t is None or not s else masked(t, s) for t, s in zip(texts.to_pylist(), found, strict=True)], texts.type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(mask, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
