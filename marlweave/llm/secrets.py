"""Secret scans: patterns, and a linear-chain conditional random field for what they miss."""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, utf8, whole_text

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is one match of HEX, and the other way round

TOKEN = re.compile(r"[\w+/@.~=-]+|[^\s\w+/@.~=-]")
WORD = np.zeros(256, bool)
WORD[[ord(c) for c in string.ascii_letters + string.digits + "_+/@.~=-"]] = True
WORD[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[ord("0") : ord("9") + 1] = True
CUES = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "key", "bearer", "authorization", "credential", "credentials", "auth", "pass", "private")
#: The names in ASSIGN anywhere, and the cues where a token that is one can be (the Kelvin sign is k in lower case).
CUE = re.compile(rb"(?i)pass|secret|token|api_?key|bearer|credential|pwd|(?<![a-z0-9_+/@~])(?:" + "|".join(CUES).replace("k", "(?:k|\u212a)").encode() + rb")(?![a-z0-9_+/@~])")
#: Digits beyond ASCII, by code point.
NUMERAL = np.zeros(0x110000, bool)
NUMERAL[[c for c in range(128, 0x20000) if chr(c).isdigit()]] = True
TAGS = ("B", "I", "O")
START = np.array([0.0, -1e9, 0.0])  # a chain does not begin inside


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself) of the patterns, in order."""
    out = [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex", m.start()) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts may hold a secret: all that the patterns or the field can find are among them."""
    out = np.zeros(len(offsets) - 1, bool)
    raw = data.tobytes()
    hits = [m.span() for m in CUE.finditer(raw)]
    at = raw.find(b"AKIA")
    while at >= 0:
        hits.append((at, at + 4))
        at = raw.find(b"AKIA", at + 4)
    # runs may go on over the end of a text: then all texts they touch are candidates
    gaps = np.concatenate([[-1], np.flatnonzero(~WORD[data]), [len(data)]])
    wide = np.flatnonzero(np.diff(gaps) > 24)
    hits += zip((gaps[wide] + 1).tolist(), gaps[wide + 1].tolist())
    digits = np.flatnonzero(DIGIT[data])
    if (data >= 128).any():
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        digits = np.concatenate([digits, np.flatnonzero((data & 0xC0) != 0x80)[NUMERAL[points]]])
    near = np.searchsorted(gaps, digits)
    runs = np.unique(near[gaps[near] - gaps[near - 1] > 8])
    for k in runs.tolist():
        a, b = int(gaps[k - 1]) + 1, int(gaps[k])
        if any(65 <= c <= 90 or 97 <= c <= 122 for c in raw[a:b]):
            hits.append((a, b))
    if hits:
        first, last = (np.searchsorted(offsets, x, side="right") - 1 for x in (np.array([h[0] for h in hits]), np.array([h[1] for h in hits]) - 1))
        out[first] = out[last] = True
        for a, b in zip(first[last > first + 1].tolist(), last[last > first + 1].tolist()):
            out[a:b] = True
    return out


def shape(token: str) -> str:
    """Runs of upper, lower, digit and other characters, at most eight."""
    out = ""
    for c in token:
        k = "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c if c in "+/_-.@=~" else "x"
        if not out or out[-1] != k:
            out += k
        if len(out) == 8:
            break
    return out


def entropy(token: str) -> float:
    return -sum(n / len(token) * math.log2(n / len(token)) for n in (token.count(c) for c in set(token)))


def is_open(token: str, cued: bool) -> bool:
    """Whether the field may tag the token; all others are outside by constraint."""
    letter = any(c.isascii() and c.isalpha() for c in token)
    digit = any(c.isdigit() for c in token)
    mixed = any(c.isupper() for c in token[1:]) and any(c.islower() for c in token)
    if len(token) >= 8 and letter and digit or len(token) >= 24 and mixed and token.isascii():
        return True
    return cued and len(token) >= 6 and letter and (digit or mixed)


def segments(text: str) -> list[tuple[list[tuple[int, int]], list[list[str]]]]:
    """Chains of neighbouring open tokens: their spans, and the features of each."""
    tokens = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
    low = [t[2].lower().strip(".=-") for t in tokens]
    n = len(tokens)
    cue = [w in CUES for w in low]
    cues = sum(cue)
    place = ["file:cues" if cues > 2 else "file:cue" if cues else "file:none", "file:code" if sum(t[2] in "{}();=" for t in tokens) * 20 > n else "file:prose"]
    out = []
    i = 0
    while i < n:
        cued = any(cue[max(0, i - 4) : i])
        if not is_open(tokens[i][2], cued):
            i += 1
            continue
        spans, rows = [], []
        while i < n and is_open(tokens[i][2], any(cue[max(0, i - 4) : i])):
            token = tokens[i][2]
            e, size = entropy(token), len(token)
            before = [low[k] for k in range(max(0, i - 3), i)][::-1]
            f = ["bias", *place, f"shape:{shape(token)}", f"size:{min(size // 4, 12)}", f"entropy:{min(int(e * 2), 10)}"]
            f += [f"has:{c}" for c in "@.+/_=-~" if c in token]
            f += ["hex"] * bool(re.fullmatch(r"[0-9a-fA-F]+", token)) + ["mixed"] * (any(c.isupper() for c in token) and any(c.islower() for c in token))
            digits = sum(c.isdigit() for c in token)
            f.append(f"digits:{digits * 5 // size}")
            f.append(f"changes:{min(sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:])) // 2, 5)}")
            f += ["foreign"] * (not token.isascii()) + ["address"] * bool(re.search(r"@|\.(com|org|net|example|html?)\b|^www\.|//", low[i]))
            f += ["prefix"] * bool(re.match(r"(gh[a-z]_|sk[-_]|pk[-_]|xox|eyJ|AIza|glpat-|hf_)", token))
            for k, w in enumerate(before):
                f.append(f"before{k}:" + ("cue" if w in CUES else w if not w.isalnum() else "open" if is_open(w, False) else "word"))
            after = low[i + 1] if i + 1 < n else "end"
            f.append("after:" + (after if not after.isalnum() or after == "end" else "open" if is_open(after, False) else "word"))
            f.append("cued" if any(w in CUES for w in before) else "free")
            spans.append(tokens[i][:2])
            rows.append(f)
            i += 1
        out.append((spans, rows))
    return out


@dataclass
class Field:
    """Weights of features for each tag, and of tag pairs."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), 3))
        for i, f in enumerate(rows):
            known = [self.index[x] for x in f if x in self.index]
            if known:
                out[i] = self.emit[known].sum(axis=0)
        return out

    def tag(self, rows: list[list[str]]) -> list[int]:
        """The best tags of a chain between outside tokens, by Viterbi."""
        s = self.scores(rows)
        best, back = s[0] + START + self.move[2], []
        for row in s[1:]:
            total = best[:, None] + self.move
            back.append(total.argmax(axis=0))
            best = total.max(axis=0) + row
        tags = [int((best + self.move[:, 2]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def learn(chains: list[tuple[list[list[str]], list[int]]], rounds: int = 150, l2: float = 0.02, rate: float = 0.15) -> Field:
    """Maximises the conditional likelihood of the tags, all chains at once, by forward-backward and Adam."""
    names = sorted({f for rows, _ in chains for r in rows for f in r})
    index = {f: i for i, f in enumerate(names)}
    n, width = len(chains), max(len(rows) for rows, _ in chains)
    real = np.zeros((n, width), bool)
    tags = np.full((n, width), 2)
    where, feature = [], []
    for c, (rows, own) in enumerate(chains):
        real[c, : len(rows)] = True
        tags[c, : len(own)] = own
        for t, r in enumerate(rows):
            where += [c * width + t] * len(r)
            feature += [index[f] for f in r]
    where, feature = np.array(where), np.array(feature)
    wall = np.full((3, 3), 0.0)
    wall[2, 1] = -1e4  # inside does not follow outside
    params = [np.zeros((len(names), 3)), np.zeros((3, 3))]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    target = np.eye(3)[tags] * real[:, :, None]
    for step in range(1, rounds + 1):
        emit, move = params[0], params[1] + wall
        s = np.zeros((n * width, 3))
        np.add.at(s, where, emit[feature])
        s = s.reshape(n, width, 3)
        fwd, bwd = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        fwd[:, 0] = s[:, 0] + move[2] + START
        for t in range(1, width):
            step_ = np.logaddexp.reduce(fwd[:, t - 1][:, :, None] + move, axis=1) + s[:, t]
            fwd[:, t] = np.where(real[:, t][:, None], step_, fwd[:, t - 1])
        last = real.sum(axis=1) - 1
        bwd[np.arange(n), last] = move[:, 2]
        for t in range(width - 2, -1, -1):
            inner = np.logaddexp.reduce(move + (s[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
            bwd[:, t] = np.where((t < last)[:, None], inner, bwd[:, t])
        z = np.logaddexp.reduce(fwd[np.arange(n), last] + move[:, 2], axis=1)
        p = np.exp(fwd + bwd - z[:, None, None]) * real[:, :, None]
        d_emit = np.zeros_like(params[0])
        np.add.at(d_emit, feature, (target - p).reshape(-1, 3)[where])
        d_move = np.zeros((3, 3))
        for t in range(1, width):
            live = real[:, t]
            pair = np.exp(fwd[live, t - 1][:, :, None] + move + (s[live, t] + bwd[live, t])[:, None, :] - z[live][:, None, None])
            d_move += (target[live, t - 1][:, :, None] * target[live, t][:, None, :] - pair).sum(axis=0)
        d_move[2] += (target[:, 0] - p[:, 0]).sum(axis=0)
        d_move[:, 2] += (target[np.arange(n), last] - p[np.arange(n), last]).sum(axis=0)
        for k, g in enumerate((d_emit, d_move)):
            g = g / n - l2 * params[k] / math.sqrt(n)
            m, v = state[k]
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.999 * v + 0.001 * g * g
            params[k] = params[k] + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(index, params[0], params[1] + wall)


def examples(seed: int = 7, n: int = 600) -> list[tuple[str, list[tuple[int, int]]]]:
    """Invented texts with secrets of public formats, and look-alikes that are none."""
    r = random.Random(seed)
    draw = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    alnum, base = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    words = "the of and file user to set service with run value on der die und que los para les des une config name host line data please call see our".split()
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    secret = [
        lambda: ["gh" + r.choice("pousr") + "_" + draw(alnum, 36)],
        lambda: ["sk-" + draw(alnum, 40)],
        lambda: ["sk_" + r.choice(["live", "test"]) + "_" + draw(alnum, 24)],
        lambda: ["xox" + r.choice("bap") + "-" + draw(string.digits, 11) + "-" + draw(alnum, 24)],
        lambda: ["AIza" + draw(alnum + "_-", 35)],
        lambda: ["eyJ" + draw(alnum, 17) + ".eyJ" + draw(alnum, 30) + "." + draw(alnum + "_-", 43)],
        lambda: [draw(base, r.randint(36, 64))],
        lambda: [draw(base, 64) for _ in range(r.randint(2, 6))],
        lambda: [draw(string.hexdigits.upper()[:16] + "", 40)],
    ]
    cued = [lambda: [draw(alnum + "_", r.randint(8, 20)) + str(r.randint(0, 99))]]
    plain = [
        lambda: "." + str(r.randint(0, 99)) + "@mail" + str(r.randint(0, 9)) + ".example.com",
        lambda: r.choice(words) + str(r.randint(1, 9999)) + "@" + r.choice(words) + ".org",
        lambda: "https://www." + draw(string.ascii_lowercase, 9) + ".com/" + draw(string.ascii_lowercase, 6) + "/" + str(r.randint(1, 9999)),
        lambda: "version" + draw(string.digits, 1) + "." + draw(string.digits, 2) + "." + draw(string.digits, 1),
        lambda: "2" + draw(string.digits, 3) + "-0" + draw("123456789", 1) + "-1" + draw(string.digits, 1) + "T1" + draw(string.digits, 1) + ":30",
        lambda: "chapter" + draw(string.digits, 2) + "-section" + draw(string.digits, 1),
        lambda: draw(string.ascii_lowercase, 10) + "." + draw(string.ascii_lowercase, 8) + str(r.randint(1, 9)),
        lambda: draw(string.ascii_lowercase, r.randint(24, 40)).capitalize() + draw(string.ascii_uppercase, 1) + draw(string.ascii_lowercase, 5),
        lambda: draw(string.ascii_lowercase, 5) + draw(string.digits, 3) + draw(string.ascii_lowercase, 4),
        lambda: draw("0123456789abcdef", 8) + "." + r.choice(["png", "html", "txt"]),
    ]
    out = []
    for _ in range(n):
        text, spans = prose(r.randint(2, 8)) + " ", []
        for _ in range(r.randint(1, 3)):
            kind = r.random()
            if kind < 0.3:
                parts = r.choice(secret)()
                if len(parts) > 1:
                    text += "-----BEGIN PRIVATE KEY-----\n"
                elif r.random() < 0.5:
                    text += r.choice(["Authorization: Bearer ", "key ", "credential ", 'token("', "pwd is ", "secret " + prose(1) + " "])
                for p in parts:
                    spans.append((len(text), len(text) + len(p)))
                    text += p + ("\n" if len(parts) > 1 else "")
            elif kind < 0.45:
                text += r.choice(["pwd is ", "passphrase: ", "credential ", "Bearer ", "private key "])
                p = r.choice(cued)()[0]
                spans.append((len(text), len(text) + len(p)))
                text += p
            else:
                text += r.choice(plain)()
            text += r.choice([" ", ", ", ". ", "\n", '" ']) + prose(r.randint(1, 6)) + " "
        out.append((text, spans))
    return out


def labelled(text: str, spans: list[tuple[int, int]]) -> list[tuple[list[list[str]], list[int]]]:
    """Chains of a text with tags: a token is of the span that holds more than half of it, and begins it if the token before is of another."""
    out = []
    for places, rows in segments(text):
        tags, before = [], None
        for a, b in places:
            own = next((s for s in spans if min(b, s[1]) - max(a, s[0]) > (b - a) / 2), None)
            tags.append(2 if own is None else 1 if own == before else 0)
            before = own
        out.append((rows, tags))
    return out


def train(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample_docs: int = 2000, sample_chains: int = 4000, doc_chains: int = 40, chain: int = 40) -> Field:
    """Learns from invented examples, and from at most ``sample_chains`` chains of at most ``sample_docs`` documents, ``doc_chains`` of each.

    In those, what the patterns match counts as secret, and every other token as none. They are
    the rows of the smallest hashes of ids; only their chains reach the driver. A chain of more than ``chain`` tokens is cut
    into pieces of so many, for training only.
    """
    rows = df.select(F.col(id_column).alias("i"), whole_text(text_column).alias("text"), F.xxhash64(F.col(id_column).cast("string")).alias("order"))
    total = rows.count()
    share = min(1.0, 1.5 * sample_docs / max(1, total))
    near = rows.where(F.pmod("order", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("order", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            order, found = [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                whole = labelled(text, [(s[3], s[1]) for s in base_spans(text)]) if text else []
                cut = [(r[k : k + chain], [2 if t[k] == 2 else 0, *t[k + 1 : k + chain]]) for r, t in whole for k in range(0, len(r), chain)]
                chains = cut[:doc_chains]
                if chains:
                    order.append(h)
                    found.append(json.dumps(chains))
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(found, pa.string())], names=["order", "chains"])

    import json

    kept = near.mapInArrow(run, "order long, chains string").orderBy("order", "chains").limit(sample_docs).collect()
    chains = [(r, t) for row in kept for r, t in json.loads(row["chains"])]
    chains = [c for text, spans in examples() for c in labelled(text, spans)] + chains[:sample_chains]
    return learn(chains)


def uncovered(a: int, b: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of [a, b) that no span holds."""
    out = []
    for x, y in sorted(spans):
        if x >= b:
            break
        if x > a:
            out.append((a, x))
        a = max(a, y)
    return [*out, (a, b)] if a < b else out


def find(text: str, field: Field) -> list[tuple[int, int, str, int]]:
    """All spans of a text: those of the patterns, and those of the field without the tokens that the patterns cover."""
    spans = base_spans(text)
    extra = []
    for places, rows in segments(text):
        tags = field.tag(rows)
        k = 0
        while k < len(tags):
            if tags[k] == 2:
                k += 1
                continue
            first = k
            k += 1
            while k < len(tags) and tags[k] == 1:
                k += 1
            a, b = places[first][0], places[k - 1][1]
            while b > a and text[b - 1] in ".,-":
                b -= 1
            # what stands before an assignment in the same token is part of its name
            taken = [(next((p for p, q in places[first:k] if kind == "assign" and p < x < q), x), y) for x, y, kind, _ in spans]
            for x, y in uncovered(a, b, taken):
                whole = [(max(x, p), min(y, q)) for p, q in places[first:k] if p < y and x < q]
                if whole and any(c.isalnum() for c in text[whole[0][0] : whole[-1][1]]):
                    extra.append((whole[0][0], whole[-1][1], "crf", whole[0][0]))
    return sorted(spans + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(df: DataFrame, field: Field | None = None, id_column: str = "doc_id", text_column: str = "text", out: str = "secrets", redacted: str | None = None, mark: str = "[SECRET]", **training) -> DataFrame:
    """Adds the array ``out`` of (kind, start, end, value_start) to every row.

    Whole texts are scanned. The kinds assign, access and hex are patterns, leftmost and not
    overlapping per kind; ``crf`` are spans of the field: tokens tagged as begin or inside of a secret from
    their shape, their neighbours and features of the file, decoded by Viterbi. Tokens that
    look like ordinary words are outside by constraint, so chains are decoded apart. Spans are in
    code points, end exclusive, by start and then kind; ``value_start`` is where the secret
    itself begins (after the name in an assignment). With ``redacted`` a column of that name has the text with
    secrets replaced by ``mark`` (it may be the text column itself).

    A null text has no spans, and stays null where redacted; rows may repeat; an empty table
    stays empty. All columns are kept; one named ``out`` is replaced. Without ``field`` one
    is trained on ``df``.
    """
    if field is None:
        field = train(df, id_column, text_column, **training)
    shared = df.sparkSession.sparkContext.broadcast(field)
    kept = df.drop(out)
    at = kept.columns.index(text_column)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64())])
    names = [c for c in kept.columns if c != redacted]
    places = [kept.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(at)
            data, offsets = utf8(texts)
            rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            clean: dict[int, str] = {}
            for a, b in blocks(offsets, 1 << 20):
                own = offsets[a : b + 1]
                if own[-1] == own[0]:
                    continue
                for i in (np.flatnonzero(candidates(data[own[0] : own[-1]], own - own[0])) + a).tolist():
                    text = texts[i].as_py()
                    spans = find(text, model)
                    rows[i] = [{"kind": k, "start": x, "end": y, "value_start": v} for x, y, k, v in spans]
                    if redacted and spans:
                        parts, last = [], 0
                        for x, y in sorted((v, y) for x, y, k, v in spans):
                            if x >= last:
                                parts += [text[last:x], mark]
                            last = max(last, y)
                        clean[i] = "".join([*parts, text[last:]])
            columns = [batch.column(k) for k in places] + [pa.array(rows, pa.list_(item))]
            labels = [*names, out]
            if redacted:
                new = [clean.get(i, None) for i in range(batch.num_rows)] if clean else None
                if new is not None:
                    import pyarrow.compute as pc

                    texts = pc.coalesce(pa.array(new, texts.type), texts)
                columns.append(texts)
                labels.append(redacted)
            yield pa.RecordBatch.from_arrays(columns, names=labels)

    result = T.StructType.fromDDL("s array<struct<kind:string,start:long,end:long,value_start:long>>").fields[0].dataType
    fields = [kept.schema[c] for c in names] + [T.StructField(out, result)] + ([T.StructField(redacted, T.StringType())] if redacted else [])
    return kept.mapInArrow(run, T.StructType(fields))
