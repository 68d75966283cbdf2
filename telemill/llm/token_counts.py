"""Token counts by section with offset-mapped attribution (operator 6).

A text is encoded once, as a whole, so its tokens are those a model would see;
counting sections one by one would give other tokens at their edges. Token
character spans are then joined with section character spans of the same text.
A token that crosses a boundary goes by an explicit rule:

- ``most``: to the section with most of its characters, the earlier one on ties;
- ``first`` / ``last``: to the section of its first / last character.

A token of several bytes of one character has that character as its span, like
its neighbours in the same character; all of them count.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm import text as T

RULES = ("most", "first", "last")
_loaded: dict[str, tuple] = {}


def _encoding(path: str, pattern: str):
    """Byte-level encoding and the byte length of every token, once per worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        lengths[list(ranks.values())] = [len(k) for k in ranks]
        _loaded[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _loaded[path]


def line_sections(text: str) -> np.ndarray:
    """Character bounds of the lines, each with its line end; one empty section for an empty text."""
    data = np.array([i + 1 for i, c in enumerate(text) if c == "\n"], np.int64) if len(text) < 64 else _line_ends(text)
    cuts = np.concatenate([[0], data, [len(text)]])
    return cuts[:-1] if len(cuts) > 2 and cuts[-1] == cuts[-2] else cuts


def _line_ends(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.flatnonzero(points == 10) + 1


def attribute(start: np.ndarray, end: np.ndarray, cuts: np.ndarray, rule: str = "most") -> np.ndarray:
    """Section of each token span [start, end) among sections between consecutive cuts; empty sections get nothing."""
    of_first = np.searchsorted(cuts, start, "right") - 1
    of_last = np.searchsorted(cuts, end - 1, "right") - 1
    if rule == "first":
        return of_first
    if rule == "last":
        return of_last
    best, most = of_first.copy(), np.minimum(end, cuts[of_first + 1]) - start
    crossing = np.flatnonzero(of_last > of_first)
    step = 1
    while len(crossing):
        s = of_first[crossing] + step
        share = np.minimum(end[crossing], cuts[s + 1]) - cuts[s]
        better = share > most[crossing]
        best[crossing[better]], most[crossing[better]] = s[better], share[better]
        crossing = crossing[of_last[crossing] > s]
        step += 1
    return best


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Character start and end of every token of the whole text."""
    encoding, lengths = _encoding(path, pattern)
    raw = text.encode()
    # one encoding call handles about a megabyte well; longer texts are cut where a word follows a single line end, a place no token crosses
    parts, begin = [], 0
    while len(text) - begin > 1_000_000:
        at = begin + 1_000_000
        while at < len(text) and not (text[at - 1] == "\n" and text[at].isalpha() and not text[at - 2].isspace()):
            at += 1
        parts.append(text[begin:at])
        begin = at
    ids = [i for p in [*parts, text[begin:]] for i in encoding.encode_ordinary(p)]
    stop = np.cumsum(lengths[np.array(ids, np.int64)]) if ids else np.zeros(0, np.int64)
    lead = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
    start = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
    return (lead[start] - 1, lead[stop - 1]) if len(stop) else (stop, stop)


def section_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "most") -> DataFrame:
    """Per line of every text: ``doc_id, section, start, length, n_tokens``; start and length in characters.

    A null or empty text has one empty section without tokens. Repeated rows are
    counted each; a null id stays null. Other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = ["doc_id", "section", "start", "length", "n_tokens"]

    def run(batches):
        for batch in T.slices(batches, "text", 4 << 20):
            cols: list[list] = [[] for _ in names]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = t or ""
                cuts = line_sections(t)
                start, end = token_spans(t, path, pattern)
                n = len(cuts) - 1
                counts = np.bincount(attribute(start, end, cuts, rule), minlength=n) if len(start) else np.zeros(n, np.int64)
                for c, x in zip(cols, ([i] * n, np.arange(n), cuts[:-1], np.diff(cuts), counts)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array([x for part in cols[0] for x in part], pa.int64()), *[pa.array(np.concatenate(c).astype(np.int64)) for c in cols[1:]]], names)

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, ", ".join(f"{n} long" for n in names))
