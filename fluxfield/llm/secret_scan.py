"""Secret scans: fixed patterns, and a token-efficiency test for strings that no pattern knows.

A byte-pair vocabulary spends few tokens on language and many on random characters. Runs of at least MIN_CHARS letters,
digits, the signs of encodings and single dots between them are random if they have fewer than MAX_RATIO characters a
token, unless they are known digests or identifiers: numbers, UUIDs, hexadecimal digests that the text before them
names as such, members of a given list, runs of one character, or names whose pieces between separators all are words
of at most 17 letters, camel case, numbers, times, or a few letters and a short number (rare words of any language take
as many tokens as chance does). A run that passes as a whole is tested in parts: outside known parts and fixed
patterns, every window of tokens of just MIN_CHARS characters or more, so that a path or a name around a secret cannot
hide it; rows of numbers, as in dates, windows without letters and windows that are names do not count. Random windows that overlap are one span. Spans of the fixed
patterns are always reported; a random string is added unless it lies inside one of them.

One scan without a shuffle; plain searches of bytes skip the texts that cannot match, so the expressions and the
tokenizer see few. Null texts count as empty: no spans, and the digest of an empty string. Repeated rows are each
returned; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_CHARS = 20
MAX_RATIO = 2.05
#: The patterns of the base rules and the least length of what they find.
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

DOTTED = re.compile(rf"[A-Za-z0-9+/_=.-]{{{MIN_CHARS},}}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
SEPARATORS = "/=_.-"
LETTER = re.compile("[A-Za-z]")
NUMBERS = re.compile("(?<![A-Za-z0-9+])[0-9]+([/=_.-]+[0-9]+)+(?![A-Za-z0-9+])")
WORD = "[A-Z]?[a-z]{1,16}|[A-Z]{1,17}|[A-Z]?[a-z]{2,14}(?:[A-Z][a-z]{2,14})+|[0-9]{1,20}e?|[a-z]{1,8}[0-9]{1,5}[a-z]?|[A-Z]{1,8}[0-9]{1,5}|[A-Z][a-z]{2,8}[0-9]{1,3}|[0-9]{1,3}[a-z]{1,2}|[0-9]{2,8}T[0-9]{2,6}Z?|[a-z]{1,10}[+]{1,2}"
NAME = re.compile(f"[/=_.-]*(?:{WORD})(?:[/=_.-]+(?:{WORD}))*[/=_.-]*")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST_NAME = re.compile(r"""(md5|sha-?1|sha-?256|sha-?512|commit|checksum|digest|integrity)["']?[\s:=-]*$""", re.IGNORECASE)
DIGEST = re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{128}")
SECRET_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
SCHEMA = "n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string"


def marks(chars: bytes) -> bytes:
    """A table for bytes.translate: x for these characters, else a space."""
    return bytes(120 if b in chars else 32 for b in range(256))


HEX_MARKS = marks(b"0123456789abcdef")
RUN_MARKS = marks(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")


def base_spans(text: str, data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = []
    low = data.lower()
    if any(n in low for n in SECRET_NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    if b"x" * HEX_CHARS in data.translate(HEX_MARKS):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= HEX_CHARS]
    return sorted(found)


def known_parts(text: str, start: int, run: str, base: list, known: frozenset[str]) -> list[tuple[int, int]]:
    """Ranges of a run at start that are no unknown random strings: fixed patterns, UUIDs, numbers and dates, named digests, known members."""
    whole = lambda a, b: (a == 0 or run[a - 1] in SEPARATORS) and (b == len(run) or run[b] in SEPARATORS)
    parts = [(max(0, a - start), min(len(run), b - start)) for a, _, b in base if a < start + len(run) and b > start]
    parts += [m.span() for m in UUID.finditer(run) if whole(*m.span())]
    parts += [m.span() for m in NUMBERS.finditer(run)]
    for m in re.finditer("[0-9a-fA-F]+", run):
        if DIGEST.fullmatch(m[0]) and whole(*m.span()) and DIGEST_NAME.search(text[max(0, start + m.start() - 20) : start + m.start()]):
            parts.append(m.span())
    if known:
        lengths = {len(k) for k in known}
        begins = [0, *(m.end() for m in re.finditer("[/=_.-]", run))]
        parts += [(a, a + n) for a in begins for n in lengths if n and a + n <= len(run) and run[a : a + n] in known and whole(a, a + n)]
    return sorted(parts)


def random_windows(part: str, token_lengths: Callable[[str], list[int]]) -> list[tuple[int, int]]:
    """Ranges of a part where a window of tokens, the shortest of MIN_CHARS characters from its first, is random."""
    found: list[tuple[int, int]] = []
    ends = [0]
    for n in token_lengths(part):
        ends.append(ends[-1] + n)
    j = 0
    for i, a in enumerate(ends):
        while j < len(ends) and ends[j] - a < MIN_CHARS:
            j += 1
        if j == len(ends):
            break
        window = part[a : ends[j]]
        if ends[j] - a < MAX_RATIO * (j - i) and len(set(window)) > 1 and LETTER.search(window) and not NAME.fullmatch(window):
            if found and a <= found[-1][1]:
                found[-1] = found[-1][0], ends[j]
            else:
                found.append((a, ends[j]))
    return found


def runs(text: str) -> Iterator[tuple[int, str]]:
    """(start, run) of the runs of MIN_CHARS characters or more."""
    for rough in DOTTED.finditer(text):
        for m in RUN.finditer(rough[0]):
            if len(m[0]) >= MIN_CHARS:
                yield rough.start() + m.start(), m[0]


def random_spans(text: str, data: bytes, base: list, token_lengths: Callable[[str], list[int]], known: frozenset[str]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of random strings outside the base spans."""
    if b"x" * MIN_CHARS not in data.translate(RUN_MARKS):
        return []
    found = []
    for start, run in runs(text):
        end = start + len(run)
        if run.isdigit() or len(set(run)) == 1 or UUID.fullmatch(run) or run in known or NUMBERS.fullmatch(run) or NAME.fullmatch(run):
            continue
        if DIGEST.fullmatch(run) and DIGEST_NAME.search(text[max(0, start - 20) : start]):
            continue
        if any(a <= start and end <= b for a, _, b in base):
            continue
        if len(run) < MAX_RATIO * len(token_lengths(run)):
            found.append((start, 3, end))
            continue
        at = 0
        for a, b in [*known_parts(text, start, run, base, known), (len(run), len(run))]:
            if a - at >= MIN_CHARS:
                found += [(start + at + x, 3, start + at + y) for x, y in random_windows(run[at:a], token_lengths)]
            at = max(at, b)
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def load_encoding(ranks_file: str, pattern: str):
    """A tiktoken encoding from a file of ranks."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _scan(ranks_file: str, pattern: str, known: frozenset[str]) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(ranks_file, pattern)
        token_lengths = lambda s: list(map(len, encoding.decode_tokens_bytes(encoding.encode_ordinary(s))))
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                data = text.encode()
                base = base_spans(text, data)
                more = random_spans(text, data, base, token_lengths, known)
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(3)), len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", *(x.split()[0] for x in SCHEMA.split(", "))])

    return scan


def scan_secrets(docs: DataFrame, ranks_file: str, pattern: str, known: frozenset[str] = frozenset(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    ranks_file and pattern are a tiktoken vocabulary's; known are digests and identifiers that are no secrets.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(ranks_file, pattern, known), f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
