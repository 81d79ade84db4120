"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds what they miss.

The patterns (e-mail, IP, payment card, phone) give the base spans, leftmost and non-overlapping for each kind; a match that
fails its test is dropped without another try. The field labels words near a digit, an @ or a spelled-out at; it is trained from
``TABLE``, decoded by Viterbi over padded numpy batches, and adds spans of its own where no base span lies and the digits or the
address hold up (a phone number without a plus, of two groups only after a cue or with a leading zero, a card of 13 to 15 digits,
a spelled-out address). Base spans always stay.

Offsets are code points, ends are exclusive. Rows: a null text is empty; rows are judged one by one; repeated ids are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, numbered, table, text_batches

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the base spans; possessive runs and look-behinds only keep long runs of digits from being tried again.
_LOCAL, _DOMAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return _NOT_DIGIT.sub("", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the run of local characters before it and a domain after it."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """By kind in the order of KINDS, then by start."""
    out: list[Span] = [("email", s, e) for s, e in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# The field

LABELS = ("O", *KINDS)
#: The labelled table: [kind text] marks a span, everything else is outside. Numbers are those set aside for fiction, documentation
#: and tests of payment; none is taken from a corpus.
TABLE = """
call me at [phone (206) 555-0123] today
phone [phone 206-555-0142] or write
tel. [phone 030 1234567] bitte
rufen Sie [phone 0228 550123] an
my number is [phone 555-867-5309] thanks
you can reach her on [phone (212) 555 0187] after six
fax [phone 206.555.0199] office
appelez le [phone 01 42 68 53 00] demain
llama al [phone 91 555 12 34] por favor
mobile [phone 0171 5551234] privat
contact [phone 1-800-555-0100] for help
the line [phone (312) 555-0147] was busy
ring [phone 020 7946 0018] before noon
text [phone 07700 900123] now
[phone (415) 555-2671] is the front desk
reached at [phone +1 (206) 555-0164] daily
write to [email john.smith@example.com] soon
mail [email anna@mail.example.org] please
[email j.doe42@example.net] is her address
send it to [email info (at) example (dot) com] today
contact [email maria (at) example.org] for details
mail [email peter [at] example [dot] net] bitte
his address [email sam(at)example(dot)com] works
the host [ip 203.0.113.77] answered
from [ip 10.0.0.1] to [ip 192.168.1.15] again
server [ip 198.51.100.23] and others
ip [ip 172.16.254.1] was blocked
paid with [card 3782 822463 10005] yesterday
card [card 378282246310005] expired
visa [card 4111 1111 1111 1111] on file
charged [card 5500-0000-0000-0004] twice
number [card 4012888888881881] was used
the card [card 3056 930902 5904] is lost
amex [card 3714 496353 98431] declined
in 2024 there were 3 of them
the year 1999 was long
from 1914 to 1918 in Europe
page 12 of 340 pages
section 3.2 and figure 4.1.2 show
version 2.0 of the Apache License
release 1.2.3 came out on 2024-01-15
on 12/05/2023 at 10:30 they met
it cost 1,250.00 in all
about 100 000 people or 1 250 000
between 20 and 30 per cent
item 000123456 in stock 42
order 8841120934 has shipped
id 1234567890123456 not found
chapter 7 verse 14 line 3
room 101 floor 5
score 3-1 in 90 minutes
isbn 978-3-16-148410-0 in print
total 555 of 867 votes
3.14159 is near pi
1 2 3 4 5 6 7 8 9 10
temperature -12.5 to 40.2 degrees
vol. 23 no. 4 pp. 555-612
section 12.4.1.7 of the code
the user @john said hello
see item #42 at 100% scale
copyright 2011-2024 all rights reserved
flight 803 at gate 12
route 66 is 3940 km long
word and other words without numbers
and so on and so forth
""".strip()  # fmt: skip

_WORD = re.compile(r"[^ \t-\r]+")
_NEAR = re.compile(r"[0-9@]|[(\[]at[)\]]")
#: Words on either side of a word with a digit or an @ that the field looks at.
REACH = 3
#: Characters of the longest words whose scores are remembered, and words in either half of that memory.
REMEMBERED, MEMO = 256, 50_000
#: Sequences that are decoded together.
BATCH = 1024


def _shape(word: str) -> str:
    """Of the whole word: letters squeezed to a or A, runs of digits with their length up to 5, other characters as they are."""
    out: list[str] = []
    run = 0
    for c in word:
        k = "0" if c in "0123456789" else "a" if c.islower() else "A" if c.isalpha() else c
        run = run + 1 if out and k == "0" and out[-1][0] == "0" else 1
        if k == "0" and run > 1:
            out[-1] = f"0{min(run, 5)}"
        elif k == "0":
            out.append("01")
        elif not out or k != out[-1] or k not in "aA":
            out.append(k)
    return "".join(out)


def _words_features(word: str) -> list[str]:
    n = sum(c in "0123456789" for c in word)
    out = ["s" + _shape(word), "n%d" % (n if n < 5 else 5 if n < 8 else 8 if n < 12 else 12)]
    if n == 0:
        out.append("w" + word.lower().strip(".,;:!?"))
    if "@" in word:
        out.append("@")
    return out


class Crf:
    """Weights: emission for each known feature and label, transitions between labels, and for the start."""

    def __init__(self, known: dict[str, int], emission: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.known, self.emission, self.move, self.start = known, emission, move, start
        #: What is known of words, in a young and an old half, so that common words stay.
        self.memo: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.old: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __getstate__(self) -> tuple:
        return self.known, self.emission, self.move, self.start

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _scores(self, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a word says of itself, of the word after it and of the word before it."""
        if (found := self.memo.get(word)) is None:
            if (found := self.old.get(word)) is None:
                fs = _words_features(word)
                found = tuple(self.emission[[self.known[k] for f in fs if (k := f"{at}{f}") in self.known]].sum(0) for at in (0, -1, 1))
            if len(word) <= REMEMBERED:
                if len(self.memo) > MEMO:
                    self.memo, self.old = {}, self.memo
                self.memo[word] = found
        return found

    def emissions(self, words: list[str]) -> np.ndarray:
        own = [self._scores(w) for w in words]
        e = np.array([o[0] for o in own])
        e[1:] += [o[1] for o in own[:-1]]
        e[:-1] += [o[2] for o in own[1:]]
        return e

    def viterbi(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each sequence of emissions, in padded batches of sequences of like length."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        for s in range(0, len(order), BATCH):
            ids = order[s : s + BATCH]
            size = np.array([len(sequences[i]) for i in ids])
            e = np.zeros((len(ids), size.max(), len(LABELS)))
            for r, i in enumerate(ids):
                e[r, : size[r]] = sequences[i]
            best = self.start + e[:, 0]
            back = np.zeros(e.shape, np.int64)
            for t in range(1, e.shape[1]):
                through = best[:, :, None] + self.move
                back[:, t] = through.argmax(1)
                # A sequence that has ended keeps its score and its label.
                live = (t < size)[:, None]
                best = np.where(live, through.max(1) + e[:, t], best)
                back[:, t] = np.where(live, back[:, t], np.arange(len(LABELS)))
            label = best.argmax(1)
            path = np.zeros(e.shape[:2], np.int64)
            for t in range(e.shape[1] - 1, -1, -1):
                path[:, t] = label
                label = back[np.arange(len(ids)), t, label]
            for r, i in enumerate(ids):
                out[i] = path[r, : size[r]]
        return out


def _parse(line: str) -> tuple[list[str], list[int]]:
    words, labels = [], []
    for m in re.finditer(r"\[(email|ip|card|phone) ((?:[^\[\]]|\[(?:at|dot)\])+)\]|(\S+)", line):
        own = m[2].split() if m[1] else [m[3]]
        words += own
        labels += [LABELS.index(m[1]) if m[1] else 0] * len(own)
    return words, labels


def train_crf(lines: list[str], steps: int = 250, rate: float = 0.1, decay: float = 0.02) -> Crf:
    """Maximum likelihood with a quadratic penalty, by Adam; forward and backward sums over all lines at once."""
    data = [_parse(x) for x in lines]
    feats = [[[f"0{f}" for f in _words_features(w)] + [f"-1{f}" for f in (_words_features(ws[i - 1]) if i else ())] + [f"1{f}" for f in (_words_features(ws[i + 1]) if i + 1 < len(ws) else ())] for i, w in enumerate(ws)] for ws, _ in data]
    known = {f: i for i, f in enumerate(sorted({f for s in feats for w in s for f in w}))}
    n, longest, k = len(data), max(len(ws) for ws, _ in data), len(LABELS)
    size = np.array([len(ws) for ws, _ in data])
    x = np.zeros((n, longest, len(known)))
    y = np.zeros((n, longest), np.int64)
    for r, (s, (_, labels)) in enumerate(zip(feats, data, strict=True)):
        y[r, : size[r]] = labels
        for t, w in enumerate(s):
            x[r, t, [known[f] for f in w]] = 1
    inside = np.arange(longest) < size[:, None]
    hot = np.eye(k)[y] * inside[:, :, None]
    pairs = inside[:, 1:]
    seen_move = np.einsum("nti,ntj->ij", hot[:, :-1] * pairs[:, :, None], hot[:, 1:])
    flat = x.reshape(-1, len(known))
    theta = np.zeros((len(known) + k + 1) * k)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        e, move, start = np.split(theta.reshape(-1, k), [len(known), len(known) + k])
        em = (flat @ e).reshape(n, longest, k)
        up, down = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        up[:, 0] = start + em[:, 0]
        for t in range(1, longest):
            up[:, t] = np.where(inside[:, t, None], np.logaddexp.reduce(up[:, t - 1, :, None] + move, 1) + em[:, t], up[:, t - 1])
        z = np.logaddexp.reduce(up[np.arange(n), size - 1], 1)
        for t in range(longest - 2, -1, -1):
            down[:, t] = np.where(inside[:, t + 1, None], np.logaddexp.reduce(move + (em[:, t + 1] + down[:, t + 1])[:, None, :], 2), 0)
        node = np.exp(up + down - z[:, None, None]) * inside[:, :, None]
        edge = np.exp(up[:, :-1, :, None] + move + (em[:, 1:] + down[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[:, :, None, None]
        g = np.concatenate([flat.T @ (node - hot).reshape(-1, k), edge.sum((0, 1)) - seen_move, (node - hot)[:, 0].sum(0)[None]]).ravel() + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    e, move, start = np.split(theta.reshape(-1, k), [len(known), len(known) + k])
    return Crf(known, e, move, start[0])


_AT = re.compile(r"@|[(\[]at[)\]]")


#: Words before a phone number, without case and punctuation; with one of them two groups of digits are enough.
_CUES = frozenset("call phone tel telephone fax mobile cell text ring dial contact reach reached number line appelez llama whatsapp".split())


def _cued(before: list[str]) -> bool:
    return any(w.lower().strip(".,;:!?()[]") in _CUES for w in before)


def _holds(kind: str, text: str, cued: bool = False) -> bool:
    """Whether a span of the field is what it says."""
    d = _digits(text)
    if kind == "email":
        return bool(_AT.search(text)) and bool(re.search(r"\.|[(\[]dot[)\]]", text)) and text[0].isalnum() and text[-1] in "abcdefghijklmnopqrstuvwxyz)]"
    if re.search(r"[^0-9 ().+-]", text):
        return False
    if kind == "phone":
        groups = re.split(r"[^0-9]+", text.strip("()+. -"))
        least = 2 if cued or d.startswith("0") else 3
        return 7 <= len(d) <= 15 and least <= len(groups) <= 6 and max(map(len, groups)) <= 7 and min(map(len, groups)) >= 1 + (len(groups) <= 4 and groups[0] != "1")
    return kind == "card" and 13 <= len(d) <= 19 and luhn(d)


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words within REACH of a word with a digit, an @ or a spelled-out at."""
    if not _NEAR.search(text):
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    out: list[list[tuple[int, int]]] = []
    last, pos = -1, 0
    for m in _NEAR.finditer(text):
        if m.start() < pos:
            continue
        lo, hi = 0, len(words)
        while lo < hi:  # the word that holds the mark
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if words[mid][1] <= m.start() else (lo, mid)
        pos = words[lo][1]
        a, b = max(lo - REACH, last), min(lo + REACH + 1, len(words))
        if a == last and out:
            out[-1] += words[last:b]
        else:
            out.append(words[max(a, 0) : b])
        last = b
    return out


def added_spans(texts: list[str], base: list[list[Span]], crf: Crf) -> list[list[Span]]:
    """What the field adds to the base spans of each text."""
    at: list[tuple[int, list[tuple[int, int]]]] = [(i, w) for i, t in enumerate(texts) for w in windows(t)]
    paths = crf.viterbi([crf.emissions([texts[i][s:e] for s, e in w]) for i, w in at])
    out: list[list[Span]] = [[] for _ in texts]
    taken = [sorted((s, e) for _, s, e in b) for b in base]
    for (i, w), path in zip(at, paths, strict=True):
        t = 0
        while t < len(path):
            end = t + 1
            while end < len(path) and path[end] == path[t]:
                end += 1
            if path[t]:
                kind, s, e = LABELS[path[t]], w[t][0], w[end - 1][1]
                while e > s and texts[i][e - 1] in ".,;:!?\"'>":
                    e -= 1
                while s < e and texts[i][s] in "\"'<:;,":
                    s += 1
                cued = kind == "phone" and _cued([texts[i][x:y] for x, y in w[max(0, t - REACH) : t]])
                if s < e and _holds(kind, texts[i][s:e], cued) and not any(x < e and s < y for x, y in taken[i]):
                    out[i].append((kind, s, e))
                    taken[i].append((s, e))
            t = end
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def redact(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping ones, as the first one's kind in brackets."""
    out, at, done = [], 0, 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= done:
            out += [text[at:s], f"[{k.upper()}]"]
        done = at = max(done, e)
    return "".join([*out, text[at:]])


def _find(crf: Crf) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            texts = [x or "" for x in b.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, crf)
            counts = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS]
            told = [pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base]), pa.array([joined(x + y) for x, y in zip(base, more, strict=True)])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, *told], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts are of base spans, ``spans`` has all."""
    text_batches(docs.sparkSession)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return id_and_text(docs).mapInArrow(_find(train_crf(TABLE.split("\n"))), schema)


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of a text replaced by its kind; the other columns, of any names, stay. A null text stays null, an
    empty one empty; repeated rows are judged alike."""
    text_batches(docs.sparkSession)
    crf = train_crf(TABLE.split("\n"))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        own = [t or "" for t in texts]
        base = [base_spans(t) for t in own]
        more = added_spans(own, base, crf)
        return pd.Series([None if t is None else redact(t, x + y) if x or y else t for t, x, y in zip(texts, base, more, strict=True)], dtype=object)

    plain, (text,) = numbered(docs, "text")
    return plain.withColumn(text, clean(F.col(text).cast("string"))).toDF(*docs.columns)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
