"""Secret scans: fixed base patterns, and a character convolutional network over every candidate.

``scan`` finds base spans (assign, access, hex) and candidate tokens in each whole text. A candidate
is a run of 12 or more token characters that holds a letter and a digit; the network reads all of it
with 20 characters before and after, in overlapping windows of 64, and the highest score counts. Every
candidate is scored, those within base spans too, and each that passes is a span of kind cnn.

The network (one embedding, one convolution, max and mean pooling, one logistic output; numpy alone) is
trained on labelled findings. The tables label no secrets, so positives are made up, and planted in
surroundings taken from a bounded sample of real texts; negatives are made-up ids, numbers, paths,
digests and words planted alike, and the sample's own candidates that lie in no base span. Base
findings label nothing. Some secrets and digests are drawn from one alphabet, so that only their
surroundings tell them apart, and not always. Findings held back from training give the calibration
(Platt's, with its smoothed targets) and the threshold: the largest that keeps the wanted recall there.

Defined cases: a null or empty text has no span; overlapping spans of different kinds all count;
spans that tie in their start stand in the order assign, access, hex, cnn; a very long text or candidate
is read whole, in as many windows as it takes; rows that repeat are scanned one by one; without any
text to sample, surroundings are made up too; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

#: The base patterns and the least length of what each must catch.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are taken whole, so this equals longer runs of [0-9a-f]+
KINDS = ("assign", "access", "hex", "cnn")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
HINTS = ("passw", "secret", "token", "apikey", "api_key")
DIGIT = re.compile(r"[0-9]")
#: Windows, the characters around a candidate, and from window to window: any 40 characters lie in one window.
WIDTH, AROUND, STEP = 64, 20, 24
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + " \n+/_.=-:\"'@#$%&*()<>,;!?"
CODE = np.zeros(0x250, np.int64)
for _k, _c in enumerate(ALPHABET):
    CODE[ord(_c)] = _k + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, by start, then kind."""
    out, low = [], text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    if not DIGIT.search(text):
        return []
    return [m.span() for m in TOKEN.finditer(text) if any("0" <= c <= "9" for c in m[0]) and any(c.isalpha() for c in m[0])]


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Codes of the candidate and its surroundings, and where the candidate lies: a row for each window."""
    lo = start - AROUND
    width = WIDTH + max(0, -(-(end + AROUND - lo - WIDTH) // STEP)) * STEP
    part = (" " * max(0, -lo) + text[max(0, lo) : lo + width]).ljust(width)
    points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = CODE[np.minimum(points, len(CODE) - 1)]
    codes[AROUND : AROUND + end - start] += len(ALPHABET) + 1
    return np.lib.stride_tricks.sliding_window_view(codes, WIDTH)[::STEP]


@dataclass
class Network:
    """Embedding, convolution of five characters, max and mean pooling, logistic output."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    slope: float = 1.0
    level: float = 0.0
    threshold: float = 0.5

    @staticmethod
    def fresh(seed: int = 3, dim: int = 8, filters: int = 24, wide: int = 5) -> Network:
        r = np.random.RandomState(seed)
        codes = 2 * (len(ALPHABET) + 1)
        return Network(r.normal(0, 0.3, (codes, dim)), r.normal(0, 0.2, (wide * dim, filters)), np.zeros(filters), r.normal(0, 0.1, 2 * filters), 0.0)

    def _pooled(self, x: np.ndarray):
        e = self.embed[x]
        wide = self.conv.shape[0] // e.shape[2]
        n = e.shape[1] - wide + 1
        cols = np.concatenate([e[:, k : k + n] for k in range(wide)], 2)
        z = np.maximum(cols @ self.conv + self.bias, 0)
        top = z.argmax(1)
        return cols, z, top, np.concatenate([np.take_along_axis(z, top[:, None, :], 1)[:, 0], z.mean(1)], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._pooled(x)[3] @ self.out + self.shift

    def logits(self, each, most: int = 2048) -> np.ndarray:
        """The highest logit of each finding's windows, about so many windows at once."""
        top, held, of, size = [], [], [], 0

        def score() -> None:
            for k, z in zip(of, np.split(self.logit(np.concatenate(held)), np.cumsum([len(x) for x in held])[:-1]), strict=True):
                top[k] = max(top[k], z.max())
            held.clear()
            of.clear()

        for k, x in enumerate(each):
            top.append(-np.inf)
            for i in range(0, len(x), most):
                held.append(x[i : i + most])
                of.append(k)
                if (size := size + len(held[-1])) >= most:
                    score()
                    size = 0
        if held:
            score()
        return np.array(top)

    def chances(self, each) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(each) + self.level, -30, 30)))

    def train(self, x: np.ndarray, y: np.ndarray, passes: int = 12, rate: float = 0.01, batch: int = 64, decay: float = 0.002, seed: int = 4) -> None:
        r = np.random.RandomState(seed)
        names = ("embed", "conv", "bias", "out")
        mean, var, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
        for _ in range(passes):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                b = order[i : i + batch]
                cols, z, top, pooled = self._pooled(x[b])
                d = (1 / (1 + np.exp(-np.clip(pooled @ self.out + self.shift, -30, 30))) - y[b]) / len(b)
                filters = z.shape[2]
                dp = d[:, None] * self.out[None]
                dz = np.repeat(dp[:, None, filters:] / z.shape[1], z.shape[1], 1)
                np.put_along_axis(dz, top[:, None, :], np.take_along_axis(dz, top[:, None, :], 1) + dp[:, None, :filters], 1)
                dz *= z > 0
                dcols = dz @ self.conv.T
                grad = {"out": pooled.T @ d, "conv": np.einsum("bnk,bnf->kf", cols, dz), "bias": dz.sum((0, 1)), "embed": np.zeros_like(self.embed)}
                dim, n = self.embed.shape[1], dcols.shape[1]
                for k in range(dcols.shape[2] // dim):
                    np.add.at(grad["embed"], x[b][:, k : k + n], dcols[:, :, k * dim : (k + 1) * dim])
                step += 1
                self.shift -= rate * d.sum()
                grad["out"] += decay * self.out
                grad["conv"] += decay * self.conv
                for name in names:
                    mean[name] = 0.9 * mean[name] + 0.1 * grad[name]
                    var[name] = 0.99 * var[name] + 0.01 * grad[name] ** 2
                    setattr(self, name, getattr(self, name) - rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(var[name] / (1 - 0.99**step)) + 1e-8))


_LETTERS, _ALNUM, _HEX = string.ascii_letters, string.ascii_letters + string.digits, "0123456789abcdef"
#: Words that stand before a made-up secret, and before a made-up digest or id.
_SECRET_WORDS = ("key", "auth", "bearer", "credential", "access", "private", "pwd", "signature", "login", "session key")
_PLAIN_WORDS = ("commit", "order", "build", "etag", "checksum", "ticket", "invoice", "file", "version", "part no")
_ONSETS = ("b", "c", "ch", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "ph", "pl", "pr", "qu", "r", "s", "sh", "st", "t", "th", "tr", "v", "w", "y", "z")
_VOWELS, _ENDS = ("a", "e", "i", "o", "u", "ai", "ea", "ee", "io", "ou"), ("", "", "n", "r", "s", "t", "l", "d", "ng", "rt", "nt", "ck", "ng", "y")
_SYLLABLES = ("the", "ing", "er", "an", "tion", "re", "on", "es", "ou", "de", "la", "en", "sch", "que")


class _Maker:
    """Draws made-up tokens: secrets of several issuers' shapes, and harmless runs of the same characters."""

    def __init__(self, seed: int):
        self.r = np.random.RandomState(seed)

    def pick(self, chars: str, n: int) -> str:
        return "".join(chars[i] for i in self.r.randint(0, len(chars), n))

    def word(self) -> str:
        """Syllables of common languages, or consonants and vowels in turn: readable either way."""
        r = self.r
        if r.rand() < 0.4:
            return "".join(_SYLLABLES[i] for i in r.randint(0, len(_SYLLABLES), r.randint(1, 4)))
        said = "".join(_ONSETS[r.randint(len(_ONSETS))] + _VOWELS[r.randint(len(_VOWELS))] for _ in range(r.randint(1, 4))) + _ENDS[r.randint(len(_ENDS))]
        return said.capitalize() if r.rand() < 0.15 else said

    def words(self) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(1, 6)))

    def secret(self) -> str:
        r, pick = self.r, self.pick
        return [
            lambda: pick(_ALNUM, r.randint(20, 48)),
            lambda: pick(_ALNUM + "+/", r.randint(28, 60)) + "=",
            lambda: pick(_HEX, r.randint(16, 31)),
            lambda: "ghp_" + pick(_ALNUM, 36),
            lambda: "sk_live_" + pick(_ALNUM, 24),
            lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(_ALNUM, 24),
            lambda: pick(string.ascii_lowercase, r.randint(2, 6)) + "_" + pick(_ALNUM, r.randint(20, 40)),
        ][r.randint(7)]()

    def harmless(self) -> str:
        r, pick, word = self.r, self.pick, self.word
        return [
            lambda: word() + word() + word() + pick(string.digits, r.randint(1, 4)),
            lambda: pick(string.digits, 4) + "-" + pick(string.digits, 2) + "-" + pick(string.digits, 2) + "T" + pick(string.digits, 6),
            lambda: word() + "_" + word() + "_" + pick(string.digits, 2) + "/" + word(),
            lambda: word() + "-" + word() + "-" + pick(string.digits, 3) + "-" + word(),
            lambda: "/".join([word(), pick(string.digits, 4), word(), word()]),
            lambda: "/" + "/".join("_".join([word(), *[pick(string.digits, r.randint(1, 5))] * r.randint(2), word()]) for _ in range(r.randint(3, 12))),
            lambda: pick(_HEX, r.randint(12, 31)),
            lambda: pick(string.ascii_uppercase, r.randint(2, 6)) + ["", "-", "_"][r.randint(3)] + pick(string.digits, r.randint(7, 15)),
            lambda: "_".join([word(), pick(string.digits, r.randint(1, 3)), *[word() for _ in range(r.randint(1, 5))]]),
        ][r.randint(9)]()


def made_up(n: int, seed: int = 9, surroundings: list[tuple[str, str]] = ()) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of invented findings, half of them secrets, planted in the surroundings."""
    m = _Maker(seed)
    out = []
    for k in range(n):
        secret = k % 2 == 0
        token = (m.secret() if secret else m.harmless()).ljust(12, "e")
        if not (any("0" <= c <= "9" for c in token) and any(c.isalpha() for c in token)):
            token += "a7"
        if len(surroundings) and m.r.rand() < 0.7:
            lead, rest = surroundings[m.r.randint(len(surroundings))]
        else:
            lead, rest = m.words() + " ", " " + m.words()
        told = _SECRET_WORDS if secret else _PLAIN_WORDS
        if m.r.rand() < (0.7 if secret else 0.4):
            lead += told[m.r.randint(len(told))] + [" = \"", ": ", "=", ": '", " "][m.r.randint(5)]
        out.append((lead + token + ["\"", "'", "", "."][m.r.randint(4)] + rest, len(lead), len(lead) + len(token), int(secret)))
    return out


def fit(findings: list[tuple[str, int, int, int]], recall: float = 0.95, made: int = 3000, surroundings: list[tuple[str, str]] = ()) -> Network:
    """Train on two of three findings; calibrate and set the threshold on the third."""
    findings = made_up(made, surroundings=surroundings) + findings
    each = [windows(t, a, b) for t, a, b, _ in findings]
    y = np.array([f[3] for f in findings], float)
    back = np.arange(len(y)) % 3 == 2
    net = Network.fresh()
    learned, held = [each[k] for k in np.flatnonzero(~back)], [each[k] for k in np.flatnonzero(back)]
    net.train(np.concatenate(learned), np.repeat(y[~back], [len(x) for x in learned]))
    z, v = net.logits(held), y[back]
    # smoothed targets: held-back findings that the logit parts fully don't make it certain
    aim = np.where(v == 1, (v.sum() + 1) / (v.sum() + 2), 1 / ((1 - v).sum() + 2))
    s = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ s, -30, 30)))
        s = s - np.linalg.solve((x.T * (p * (1 - p))) @ x / len(z) + 1e-3 * np.eye(2), x.T @ (p - aim) / len(z))
        s[0] = np.clip(s[0], 0.05, 20)
    net.slope, net.level = map(float, s)
    chances = np.sort(net.chances(held)[v == 1])
    net.threshold = float(chances[int((1 - recall) * len(chances))]) if len(chances) else 0.5
    return net


def sample_findings(docs: DataFrame, most_texts: int = 400, most_chars: int = 4000) -> tuple[list[tuple[str, int, int, int]], list[tuple[str, str]]]:
    """Of a bounded sample of texts: candidates in no base span, as negatives, and surroundings to plant findings in.

    Half of the sample are texts with a candidate, half any texts.
    """
    ship(docs.sparkSession)
    likely = F.col("text").rlike("[A-Za-z+/_=-]{4,}[0-9][A-Za-z0-9+/_=-]{7,}|[0-9][0-9a-f]{31,}")
    short = docs.where(F.length("text").between(1, most_chars)).select("text", F.xxhash64("text").alias("k"))
    first = lambda df: df.orderBy("k", "text").limit(most_texts // 2).collect()
    negatives, surroundings = [], []
    for r in [*first(short.where(likely)), *first(short)]:
        base = base_spans(r.text)
        for a, b in candidates(r.text):
            if not any(s < b and a < e for s, _, e in base):
                lo = max(0, a - AROUND)
                negatives.append((r.text[lo : b + WIDTH], a - lo, b - lo, 0))
        blanks = [m.start() for m in re.finditer(" ", r.text)]
        for at in blanks[:: max(1, len(blanks) // 4)]:
            if not any(s - 2 * AROUND < at < e + 2 * AROUND for s, _, e in base):
                surroundings.append((r.text[max(0, at - 2 * AROUND) : at + 1], r.text[at : at + 2 * AROUND]))
    return negatives, surroundings


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans (both kind:start:end joined by commas), n_cnn."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [base_spans(t) if t else [] for t in texts]
            tried = []
            for k, t in enumerate(texts):
                if t:
                    tried += [(k, a, b) for a, b in candidates(t)]
            more: list[list] = [[] for _ in texts]
            p = net.chances(windows(texts[k], a, b) for k, a, b in tried)
            for (k, a, b), chance in zip(tried, p, strict=True):
                if chance >= net.threshold:
                    more[k].append((a, 3, b))
            say = lambda spans: ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)
            count = lambda kind: pa.array([sum(x[1] == kind for x in f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), count(0), count(1), count(2), pa.array([say(f) for f in found], pa.string()), pa.array([say(sorted(f + m)) for f, m in zip(found, more, strict=True)], pa.string()), pa.array([len(m) for m in more], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "n_cnn"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, n_cnn long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    negatives, surroundings = sample_findings(docs)
    found = scan(docs, fit(negatives, surroundings=surroundings))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
