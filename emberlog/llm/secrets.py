"""Operator 3, secret scans: a character convolutional network over candidates and their context."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Folder
from .common import documents_like, pick, shared_dir, table

#: Characters before the candidate, of it and after it that the network sees at once. Longer
#: candidates are seen in steps of SPAN, and the highest score counts.
BEFORE, SPAN, AFTER = 32, 64, 16
WIDE = BEFORE + SPAN + AFTER
#: Labelled findings that the network is trained on, calibrated on and (for tests) held out.
TRAINED, CALIBRATED = 4500, 1500
#: Recall on the calibration findings that the threshold must keep.
RECALL = 0.998
REDACTED = "<SECRET>"

_RUN = re.compile(r"[A-Za-z0-9_+/=~.\-]{16,}").finditer
_SIGN = re.compile(r"[=:]").finditer
# a value ends where a further 'name=' follows a separator
_VALUE = re.compile(r"\s{0,3}[\"']?((?:(?![&;,]\s?[A-Za-z_][\w .\-]{0,30}[=:])[^\s\"'<>]){6,})").match
_USERINFO = re.compile(r":(?://[^\s/@:\"'<>]*:([^\s/\"'<>]{6,})|(?<=\w:)(?<!(?i:mail):)(?<!(?i:mailto):)(?<!(?i:contact):)(?<!(?i:from):)(?<!(?i:sip):)([^\s/@:\"'<>]{6,}))@(?=[\w\[])").finditer
_KEYWORD = re.compile(r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|(api|access|auth|private|secret)[_-]?key|credential|bearer|auth)[\"']?\s{0,3}$").search
_MIXED = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]").search


def _is_run(run: str) -> bool:
    return len(run) >= 16 and (any(c.isdigit() for c in run) or len(run) >= 20 and (bool(_MIXED(run)) or run.isupper()))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans, in order and apart, of long runs with digits, mixed case or capitals only, of values assigned to a
    credential's name (wherever its sign stands, also after other assignments without a space), and
    of passwords in 'user:password@host'."""
    found = []
    for m in _RUN(text):
        run = m.group().rstrip(".=-") if m.group()[-1] in ".-" else m.group()
        if _is_run(run):
            start = m.start()
            # 'name=value' is one run: the value is the candidate, and what other assignments precede it
            for sign in _SIGN(run):
                at = sign.start()
                if len(run) - at > 6 and _KEYWORD(run[max(0, at - 24) : at]):
                    if "=" in run[:at] and _is_run(run[:at]):
                        found.append((start, start + at))
                    start, run = start + at + 1, run[at + 1 :]
                    break
            found.append((start, start + len(run)))
    until = 0
    for m in _SIGN(text):
        # a value's end doesn't depend on where it starts: signs inside a value add nothing
        if m.end() > until and _KEYWORD(text[max(0, m.start() - 24) : m.start()]) and (v := _VALUE(text, m.end())):
            until = v.end(1)
            value = v.group(1).rstrip(".,;:!)]}#$%&*")
            if len(value) >= 6:
                found.append((v.start(1), v.start(1) + len(value)))
    found += [m.span(m.lastindex) for m in _USERINFO(text)]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


_CODE = np.full(128, 95, np.uint8)
for _i, _c in enumerate(map(chr, range(32, 127))):
    _CODE[ord(_c)] = _i
_CODE[10] = _CODE[13] = _CODE[9] = 0
PAD, CODES = 96, 97


def _coded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < 128, _CODE[np.minimum(points, 127)], 95).astype(np.uint8)


def windows(text: str, start: int, end: int) -> np.ndarray:
    """What the network sees of a candidate: rows of WIDE codes and whether they're the candidate's."""
    rows = []
    for at in range(start, end, SPAN):
        to = min(at + SPAN, end)
        row = np.full((WIDE, 2), (PAD, 0), np.uint8)
        lead, rest = _coded(text[max(0, at - BEFORE) : at]), _coded(text[at : to + AFTER])
        row[BEFORE - len(lead) : BEFORE, 0] = lead
        row[BEFORE : BEFORE + len(rest), 0] = rest
        row[BEFORE : BEFORE + to - at, 1] = 1
        rows.append(row)
    return np.stack(rows)


class CharCNN:
    """Embedding, one convolution, maxima over the candidate and over its context, logistic output."""

    def __init__(self, seed: int = 3, size: int = 12, width: int = 7, filters: int = 32):
        rng = np.random.default_rng(seed)
        self.width, self.filters = width, filters
        self.p = {
            "emb": rng.normal(0, 0.3, (CODES, size)).astype(np.float32),
            "conv": rng.normal(0, (2 / (width * (size + 1))) ** 0.5, (width * (size + 1), filters)).astype(np.float32),
            "bias": np.zeros(filters, np.float32),
            "out": rng.normal(0, 0.1, (2 * filters,)).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }
        self.a, self.b, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        codes, mask = x[..., 0], x[..., 1].astype(np.float32)
        seen = np.concatenate((self.p["emb"][codes], mask[..., None]), axis=2)
        n, length, depth = seen.shape
        steps = length - self.width + 1
        strides = (seen.strides[0], seen.strides[1], seen.strides[1], seen.strides[2])
        cols = np.lib.stride_tricks.as_strided(seen, (n, steps, self.width, depth), strides).reshape(n * steps, self.width * depth)
        act = np.maximum(cols @ self.p["conv"] + self.p["bias"], 0).reshape(n, steps, self.filters)
        middle = mask[:, self.width // 2 : self.width // 2 + steps, None]
        inner, outer = act * middle, act * (1 - middle)
        at = inner.argmax(1), outer.argmax(1)
        pooled = np.concatenate((np.take_along_axis(inner, at[0][:, None], 1)[:, 0], np.take_along_axis(outer, at[1][:, None], 1)[:, 0]), axis=1)
        return codes, cols, at, pooled, pooled @ self.p["out"] + self.p["out_bias"]

    def logits(self, x: np.ndarray, batch: int = 256) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + batch])[-1] for i in range(0, len(x), batch)]) if len(x) else np.zeros(0, np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        codes, cols, at, pooled, logit = self._forward(x)
        n, steps = len(x), WIDE - self.width + 1
        d = (1 / (1 + np.exp(-logit)) - y) / n
        g = {"out": pooled.T @ d, "out_bias": np.array([d.sum()])}
        down = d[:, None] * self.p["out"][None] * (pooled > 0)
        g["conv"], g["bias"] = np.zeros_like(self.p["conv"]), np.zeros_like(self.p["bias"])
        g["emb"] = np.zeros_like(self.p["emb"])
        depth = self.p["emb"].shape[1] + 1
        kernels = self.p["conv"].T.reshape(self.filters, self.width, depth)[:, :, :-1]
        for half in (0, 1):
            part = down[:, half * self.filters : (half + 1) * self.filters]
            picked = cols[np.arange(n)[:, None] * steps + at[half]]
            g["conv"] += np.einsum("nfd,nf->df", picked, part, optimize=True)
            g["bias"] += part.sum(0)
            back = (kernels[None] * part[:, :, None, None]).reshape(-1, depth - 1)
            seen = codes[np.arange(n)[:, None, None], at[half][:, :, None] + np.arange(self.width)].ravel()
            for k in range(depth - 1):
                g["emb"][:, k] += np.bincount(seen, back[:, k], CODES)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 5) -> CharCNN:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                pick_ = order[i : i + batch]
                t += 1
                for k, g in self._gradients(x[pick_], y[pick_]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def calibrate(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, recall: float = RECALL) -> CharCNN:
        """Platt's scaling by Newton steps (with his smoothed targets), then the largest threshold
        that keeps ``recall`` of the calibration findings. What is scaled is what scans use: the
        largest logit of a finding's windows."""
        z = highest(self.logits(x).astype(np.float64), owner)
        up, down = y.sum(), (1 - y).sum()
        target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * z + b)))
            w = p * (1 - p) + 1e-9
            grad = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]])
            step = np.linalg.solve(hess, grad)
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-9:
                break
        self.a, self.b = float(a), float(b)
        known = np.sort(1 / (1 + np.exp(-(a * z[y > 0] + b))))
        self.threshold = float(min(0.5, known[int((1 - recall) * len(known))]))
        return self

    def scores(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The calibrated probability of each candidate; ``owner``: of which candidate a window is, ascending from 0."""
        return 1 / (1 + np.exp(-(self.a * highest(self.logits(x).astype(np.float64), owner) + self.b)))

    def to_json(self) -> dict:
        arrays = {k: [str(v.dtype), list(v.shape), base64.b64encode(v.tobytes()).decode()] for k, v in self.p.items()}
        return {"width": self.width, "filters": self.filters, "a": self.a, "b": self.b, "threshold": self.threshold, "p": arrays}

    @classmethod
    def from_json(cls, found: dict) -> CharCNN:
        model = cls(width=found["width"], filters=found["filters"])
        model.p = {k: np.frombuffer(base64.b64decode(data), kind).reshape(shape) for k, (kind, shape, data) in found["p"].items()}
        model.a, model.b, model.threshold = found["a"], found["b"], found["threshold"]
        return model


def highest(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The largest of each owner's values."""
    return np.maximum.reduceat(values, np.flatnonzero(np.diff(owner, prepend=-1))) if len(values) else values


# -- labelled findings ------------------------------------------------------------------------

_HEX, _ALNUM, _B64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
_SYLLABLES = "the an er on in st le re de la que ment tion und der ge ein sch es os ción ado mo ta li ra ko wo ha ou".split()
_NAMES = "password passwd pwd secret token api_key apikey access_token auth_token client_secret private_key secret_key db_password credential".split()


def labelled_findings(count: int, seed: int) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, 1 for a secret): credentials of known and free forms in the places
    where they occur (also among other assignments, and in URLs), and runs that look alike (checksums,
    ids, card numbers, paths, placeholders, addresses)."""
    rng = random.Random(seed)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    word = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 9))) + rng.choice([" ", " ", ". ", ".\n", "\n", ", "])
    free = lambda: some(rng.choice([_HEX, _HEX, _HEX.upper(), _ALNUM, _ALNUM, _B64, _ALNUM + "!@$%^&*_-"]), rng.choice([12, 16, 18, 20, 24, 32, 40, 40, 48, 64]))
    known = (
        lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16),
        lambda: "ghp_" + some(_ALNUM, 36),
        lambda: rng.choice(["sk_live_", "sk-", "rk_live_"]) + some(_ALNUM, rng.choice([24, 32, 48])),
        lambda: "xoxb-" + some(string.digits, 12) + "-" + some(_ALNUM, 24),
        lambda: "AIza" + some(_ALNUM + "_-", 35),
        lambda: "eyJ" + some(_ALNUM, 30) + ".eyJ" + some(_ALNUM, 60) + "." + some(_ALNUM + "_-", 43),
        lambda: "glpat-" + some(_ALNUM + "_-", 20),
    )
    plain = (
        lambda: (rng.choice(["commit ", "sha1: ", "revision ", "git checkout "]), some(_HEX, 40)),
        lambda: (rng.choice(["md5 ", "md5sum: ", "checksum=", "etag: ", "digest: "]), some(_HEX, 32)),
        lambda: (rng.choice(["sha256:", "sha256 = ", "integrity "]), some(_HEX, 64)),
        lambda: (rng.choice(["id=", "uuid: ", "request ", "urn:uuid:", ""]), "-".join(some(_HEX, n) for n in (8, 4, 4, 4, 12))),
        lambda: (rng.choice(["", "", "card ", "order "]), some(string.digits, rng.choice([16, 16, 16, 18, 20]))),
        lambda: ("", "/".join(word() for _ in range(4)) + f"/{rng.randint(1, 9999)}.html"),
        lambda: ("", f"{word()}_{word()}-{rng.randint(1, 20)}.{rng.randint(0, 9)}.{rng.randint(0, 99)}.tar.gz"),
        lambda: ("", "".join(word().capitalize() for _ in range(5))),
        lambda: (rng.choice(_NAMES) + rng.choice(["=", " = ", ": ", ' = "']), rng.choice(["changeme", "your_token_here", "YOUR-API-KEY", "xxxxxxxxxxxxxxxx", "<password>", "example", "********", "placeholder", "undefined", "required", word() * 2, word() * 2])),
        lambda: ("", f"20{some(string.digits, 2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}.{some(string.digits, 2)}.{some(string.digits, 2)}"),
        lambda: ("", f"{word()}.{rng.randint(1, 99)}{rng.choice(['@mail', '.host'])}{rng.randint(1, 9)}.example.com"),
        lambda: ("", "-".join(word() for _ in range(5)) + f"-{rng.randint(1, 9999)}"),
    )
    short = lambda: rng.choice([word() + some(string.digits, rng.randint(2, 4)), some(_ALNUM, 6) + rng.choice(string.digits), some(_ALNUM, 4) + rng.choice("!@$%^*_-") + some(_ALNUM, 4) + rng.choice(string.digits)]).rjust(6, "q")
    names = lambda: rng.choice([str, str, str.capitalize])(rng.choice(["pwd", "password", "token", *_NAMES]))
    host = lambda: f"{word()}{rng.choice(['', '1', '2'])}.{rng.choice(['local', 'example.com', 'example.net'])}"
    user = lambda: word() + rng.choice(["", "", some(string.digits, rng.randint(1, 3))])
    among = (
        lambda: (f"{rng.choice(['Server', 'Host', 'Data Source'])}={host()};{rng.choice(['Uid', 'User Id'])}={user()};{names()}=", rng.choice(["", ";", f";Timeout={rng.randint(1, 90)}"])),
        lambda: (f"{rng.choice(['GET /', 'https://' + host() + '/'])}{word()}?{rng.choice(['user', 'state', 'id'])}={user()}&{names()}=", rng.choice(["", "", f"&page={rng.randint(1, 9)}"])),
        lambda: (f"{rng.choice(['user', 'login', 'name'])}:{user()},{names()}:", rng.choice(["", f",role:{word()}"])),
        lambda: (f"{rng.choice(['cfg', 'env', 'db', 'args'])}:{names()}=", ""),
        lambda: (f"{rng.choice(['https', 'postgres', 'redis', 'amqp', 'ftp'])}://{rng.choice([user(), user(), ''])}:", f"@{host()}{rng.choice(['', ':5432', '/' + word()])}"),
    )
    dull = lambda: rng.choice(["changeme", "example", "placeholder", "undefined", "required", "xxxxxxxx", "password", "your_password"])
    apart = (
        lambda: (rng.choice(["", "db: "]), f"{rng.choice(['Server', 'Host', 'DataSource'])}={host()}".ljust(16, "0"), f";Uid={user()};{names()}={short()}"),
        lambda: ("https:", f"//{host()}/{word()}/{rng.randint(1, 999)}".ljust(16, "0"), f"?state={user()}&{names()}={short()}"),
    )
    found = []
    for _ in range(count):
        before, after = prose(), rng.choice([" ", " ", " ", "\n", ". "]) + prose()
        if rng.random() < 0.3:
            label = int(rng.random() < 0.5)
            if label or rng.random() < 0.5:
                lead, rest = rng.choice(among)()
                value = rng.choice([short, short, lambda: some(_ALNUM, rng.choice([12, 16, 20, 32]))])() if label else dull()
            else:
                lead, value, rest = rng.choice(apart)()
            before, after = before + lead, rest + after
        elif rng.random() < 0.5:
            if rng.random() < 0.4:
                before, value = before + rng.choice(["", "", rng.choice(_NAMES) + rng.choice(["=", ": ", ' = "'])]), rng.choice(known)()
            else:
                name = rng.choice(_NAMES)
                sign, quote = rng.choice(["=", ": ", " = ", "=", ":"]), rng.choice(["", "", '"', "'"])
                before, value, after = before + name + sign + quote, free(), quote + after
                if rng.random() < 0.15:
                    before = before[: -len(name + sign + quote)] + "Authorization: Bearer "
            label = 1
        else:
            lead, value = rng.choice(plain)()
            before, label = before + lead, 0
            if lead.endswith('"'):
                after = '"' + after
        if rng.random() < 0.12:
            noise = rng.choice(["!!", "###", "$$$", "%%%", "&&&", "***"])
            before, after = before.replace(" ", noise + " ", 3), noise + after
        if rng.random() < 0.1:
            before, after = before.upper(), after.upper()
            value = value.upper() if set(value) <= set(_HEX) else value
        found.append((before, value, after, label))
    return found


def featurised(findings: list[tuple[str, str, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of whole candidates, the finding that each is of, and the findings' labels."""
    x = [windows(b + v + a, len(b), len(b) + len(v)) for b, v, a, _ in findings]
    return np.concatenate(x), np.repeat(np.arange(len(x)), [len(w) for w in x]), np.array([f[3] for f in findings], np.float32)


@lru_cache(2)
def trained(seed: int = 11) -> CharCNN:
    """The network, trained and calibrated on labelled findings; always the same for a seed."""
    x, owner, y = featurised(labelled_findings(TRAINED, seed))
    return CharCNN().fit(x, y[owner]).calibrate(*featurised(labelled_findings(CALIBRATED, seed + 1)))


_kept: dict[str, CharCNN] = {}


def kept_model(spark: SparkSession) -> CharCNN:
    """``trained()``, kept in the shared folder: later sessions read it, unless this file has changed."""
    name = f"secret-model-{hashlib.sha256(Path(__file__).read_bytes()).hexdigest()[:16]}.json"
    if name not in _kept:
        folder = Folder(spark, shared_dir(spark))
        if name in folder.names():
            _kept[name] = CharCNN.from_json(folder.read_json(name))
        else:
            _kept[name] = trained()
            folder.write_json(_kept[name].to_json(), name)  # another session may have written the same
    return _kept[name]


# -- scans ------------------------------------------------------------------------------------


def _found(texts: list[str | None], model: CharCNN) -> list[list[tuple[int, int, float]]]:
    """(start, end, score) of each text's findings."""
    spans = [(i, a, b) for i, t in enumerate(texts) if t for a, b in candidates(t)]
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    for k in range(0, len(spans), 512):
        part = spans[k : k + 512]
        seen = [windows(texts[i], a, b) for i, a, b in part]
        scores = model.scores(np.concatenate(seen), np.repeat(np.arange(len(seen)), [len(w) for w in seen]))
        for (i, a, b), score in zip(part, scores.tolist()):
            if score >= model.threshold:
                out[i].append((a, b, score))
    return out


def _scanned(model: CharCNN):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = part.column(0).to_pylist()
                rows = [(ids[i], a, b, round(s, 4)) for i, f in enumerate(_found(part.column(1).to_pylist(), model)) for a, b, s in f]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "start_char", "end_char", "score"])

    return run


def find_secrets(docs: DataFrame, model: CharCNN | None = None) -> DataFrame:
    """Credentials in texts: doc_id, start_char, end_char, score (calibrated probability).

    Candidates are all long runs with digits or mixed case, all values (of 6 characters at least)
    assigned to a credential's name and all passwords in 'user:password@host', anywhere in a text. The network scores each with its surroundings, and those
    above the recall-constrained threshold are findings; a long candidate has the highest score of
    its windows, for which the probability is calibrated. It is trained on the driver from TRAINED
    labelled findings, kept in the shared folder and sent to the executors (about 20 KB). Null and
    empty texts have no findings; very long texts and candidates are scanned whole; candidates that
    overlap are one; a score equal to the threshold is a finding; null doc_ids stay null; repeated
    rows are each scanned; an empty table gives an empty result. Other columns are ignored.
    """
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(_scanned(model or kept_model(docs.sparkSession)), "doc_id bigint, start_char bigint, end_char bigint, score double")


def redact(text: str, spans: list[tuple[int, int, float]]) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        out += [text[at:a], REDACTED]
        at = b
    return "".join([*out, text[at:]])


def _redacted(model: CharCNN):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts, sizes = part.column(1).to_pylist(), part.column(4).to_pylist()
                for i, spans in enumerate(_found(texts, model)):
                    if spans:
                        texts[i] = redact(texts[i], spans)
                        sizes[i] = len(texts[i])
                columns = [part.column(0), pa.array(texts, pa.string()), part.column(2), part.column(3), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "lang", "source", "n_chars"])

    return run


def redact_secrets(docs: DataFrame, model: CharCNN | None = None) -> DataFrame:
    """``docs`` with every finding of ``find_secrets`` replaced by REDACTED, and ``n_chars`` of the
    changed texts. All documents stay; columns other than those of ``documents`` are dropped."""
    docs = documents_like(docs).select(F.col("doc_id").cast("bigint"), "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("bigint"))
    return docs.mapInArrow(_redacted(model or kept_model(docs.sparkSession)), "doc_id bigint, text string, lang string, source string, n_chars bigint")


def op3_secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
