"""Secret scans: three patterns, and the guess cost of what follows a credential word.

A value in a credential context is segmented into common words, dates, repeats, keyboard walks and
brute-force spans, so that the product of their guess counts is least; a value that still needs many
guesses is reported as a secret of kind ``guess``, whatever its length and letters, also where it
overlaps what a pattern found. Values that cost few guesses (prose, placeholders) are not; words are
those of COMMON and the whole words of the public tokenizer, commonest first.

Defined results for odd input: a null text is empty; a text without a match gives zero counts, an
empty span list and the digest of the empty string; repeated rows give one result each; other columns
are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # shorter runs fail, and so does any later part of the same run
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What stands before a credential. The words of ASSIGN count anywhere, as they do there; the others not within a word.
CONTEXT = re.compile(
    r"""(?:(?i:password|passwd|secret|token|api[_-]?key)|(?:(?<![^\W_])|(?<=[a-z])(?=[A-Z]))(?i:pwd|pass|passphrase|passcode|pin|auth|bearer|credentials?|login|private[_-]?key|access[_-]?key|secret[_-]?key))["']?\s*(?i:[:=]+>?|\bis\b:?)\s*["']?"""
)
CONTEXT_WORDS = (*ASSIGN_WORDS, "api-key", "pwd", "pass", "pin", "auth", "bearer", "credential", "login", "private", "access")
#: A credential's value runs to the next blank or quote.
VALUE = re.compile(r"[^\s\"']+")

# Words that people use in passwords, commonest first.
COMMON = """password welcome admin letmein login master secret dragon monkey sunshine princess football baseball
shadow superman batman trustno love hello freedom whatever charlie michael jordan hunter test user root guest
default changeme example sample token access server system service database account private public key pass
summer winter spring autumn monday friday january august october december company office internet computer
google apple orange banana cookie coffee cheese flower silver golden purple yellow green black white blue red
the and you for with this that from your have""".split()
#: Letters of a tokenizer's word at least; shorter ones are as cheap letter by letter.
TOKEN_WORD = re.compile(r"([a-z]{4,})</w>")
# Rows of a keyboard, and letters that figures stand for.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("0134578@$!", "oieastbasi")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?\d\d(?:[-/.]?\d\d)?)?|\d\d[-/.]?\d\d[-/.]?(?:19|20)?\d\d")
WALK = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
#: Decimal digits of guesses from which a value counts as a secret.
GUESS_DIGITS = 10.0


@functools.cache
def ranks() -> tuple[dict[str, int], int]:
    """The rank of each word, and the length of the longest; read once a process."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    more = (m[1] for t in sorted(vocabulary, key=vocabulary.get) if (m := TOKEN_WORD.fullmatch(t)))
    rank = {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *more]))}
    return rank, max(map(len, rank))


def alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


def guess_cost(value: str, enough: float = math.inf) -> float:
    """log10 of the fewest guesses that a segmentation of ``value`` needs; linear steps over its places.

    Once no segmentation can cost less than ``enough``, some cost of at least that is returned.
    """
    rank_of, longest = ranks()
    # A word or date may reach so far into a repeat or walk, which then starts later; two in a row cost more than one.
    reach = max(longest, 10)
    n, low = len(value), value.lower()
    cheap = 0  # the last place that costs less than enough
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    repeat = walk = 1  # how long a repeat, a walk that ends here is
    for end in range(1, n + 1):
        c = value[end - 1]
        best[end] = best[end - 1] + math.log10(alphabet(c))
        if end > 1:
            repeat = repeat + 1 if c == value[end - 2] else 1
            walk = walk + 1 if (low[end - 2], low[end - 1]) in WALK else 1
        for k in range(max(3, repeat - reach), repeat + 1):
            best[end] = min(best[end], best[end - k] + math.log10(alphabet(c) * k))
        for k in range(max(3, walk - reach), walk + 1):
            best[end] = min(best[end], best[end - k] + math.log10(2 * 47 * k))
        for k in range(2, min(longest, end) + 1):
            word = low[end - k : end]
            rank = rank_of.get(word)
            tricks = 0 if value[end - k : end] == word else 1
            if rank is None and (rank := rank_of.get(plain[end - k : end])) is not None:
                tricks += 1
            if rank is not None:
                best[end] = min(best[end], best[end - k] + math.log10(rank * 4**tricks + 1))
        for k in (4, 6, 8, 10):
            if k <= end and DATE.fullmatch(value, end - k, end):
                best[end] = min(best[end], best[end - k] + math.log10(365 * 119 if k > 4 else 119))
        # Words and dates start within the places looked at; a longer repeat or walk costs no less later on.
        if best[end] < enough:
            cheap = end
        elif end - cheap >= reach:
            return best[end]
    return best[n]


def find(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of all spans, by start, then kind."""
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT_WORDS):
        weighed = 0
        for m in CONTEXT.finditer(text):
            # A context within a value that was weighed has an end of that value, which costs no more.
            value = VALUE.match(text, m.end()) if m.end() >= weighed else None
            if value:
                weighed = value.end()
                if guess_cost(value[0], GUESS_DIGITS) >= GUESS_DIGITS:
                    found.append((*value.span(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _columns(texts: list[str | None]) -> list[list]:
    out: list[list] = [[], [], [], [], []]
    for text in texts:
        spans = find(text) if text else []
        base = [s for s in spans if s[2] != "guess"]
        for col, kind in zip(out, KINDS[:3], strict=False):
            col.append(sum(s[2] == kind for s in base))
        out[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
        out[4].append(joined(spans))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``; no rows move."""
    arrow_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        for batch in batches:
            cols = _columns(batch.column(1).to_pylist())
            arrays = [batch.column(0)] + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.mapInArrow(run, f"doc_id {id_type}, {SCHEMA}")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark``; all columns stay, ``n_chars`` follows the text."""
    arrow_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                end, parts = 0, []
                for a, b, _ in find(text) if text else ():
                    if a >= end:
                        parts += [text[end:a], mark]
                    elif b <= end:
                        continue
                    end = b
                texts.append("".join([*parts, text[end:]]) if parts else text)
            arrays = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
