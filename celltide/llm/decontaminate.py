"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Words are maximal runs of ASCII digits, letters (A-Z lower-cased) and all non-ASCII
characters. Every item gives windows of `width` consecutive words; an item with fewer words,
but at least one, is one window. A text is normalised once, scanned once, and every
occurrence is mapped back to word numbers and to character offsets of the original text.

Defined results: null or empty texts have no words and no hits; null or wordless items give
no window; items with a null id are ignored; an item id that repeats stands for the union of
its rows; repeated documents each keep their own row; an empty benchmark hits nothing; extra
columns pass through.

Scale: documents are only mapped over, never shuffled. The benchmark is measured by Spark
first; beyond `part_bytes` it is split by item hash into parts of bounded size, one automaton
each, and the documents pass through the parts one after the other in the same stage.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from celltide.llm.common import map_text

WIDTH = 10
PART_BYTES = 4 << 20

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("runs", T.ArrayType(T.LongType())),
        T.StructField("spans", T.ArrayType(T.LongType())),
    ]
)


def words(text: str | None) -> list[bytes]:
    """Normalised words as UTF-8 bytes."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def windows(text: str | None, width: int = WIDTH) -> set[tuple[bytes, ...]]:
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def automaton(items: list[tuple[str, str]], width: int) -> tuple[ahocorasick.Automaton, list]:
    """The automaton and, by window number, (number of words, item ids)."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        for w in windows(text, width):
            found.setdefault(w, set()).add(item)
    machine, outputs = ahocorasick.Automaton(), []
    for k, (w, ids) in enumerate(found.items()):
        machine.add_word(f" {b' '.join(w).decode('latin-1')} ", k)
        outputs.append((len(w), sorted(ids)))
    if outputs:
        machine.make_automaton()
    return machine, outputs


_machines: dict[str, tuple] = {}


def _cached(items: list[tuple[str, str]], width: int) -> tuple:
    key = hashlib.sha256(repr((width, items)).encode()).hexdigest()
    if key not in _machines:
        _machines.clear()  # at most one automaton in a worker
        _machines[key] = automaton(items, width)
    return _machines[key]


def _merge(runs: list[int], more: list[int]) -> list[int]:
    """Union of half-open [start, end) runs given flat."""
    pairs = sorted([*zip(runs[::2], runs[1::2]), *zip(more[::2], more[1::2])])
    out: list[int] = []
    for a, b in pairs:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def scan(text: str | None, machine, outputs: list) -> tuple[int, set[str], list[int]]:
    """Number of words, items that occur, and the hit words as flat half-open runs."""
    w = words(text)
    items: set[str] = set()
    runs: list[int] = []
    if w and outputs:
        line = f" {b' '.join(w).decode('latin-1')} "
        at = seen = 0  # `seen` spaces lie before position `at`
        seen_windows = set()
        for end, k in machine.iter(line):
            seen += line.count(" ", at, end)
            at = end
            n, ids = outputs[k]
            if k not in seen_windows:
                seen_windows.add(k)
                items.update(ids)
            a = seen - n
            if runs and a <= runs[-1]:
                runs[-1] = max(runs[-1], seen)
                while len(runs) > 2 and a <= runs[-3]:  # a longer window may reach back over earlier runs
                    runs[-4:] = [min(runs[-4], a), max(runs[-3], runs[-1])]
                runs[-2] = min(runs[-2], a)
            else:
                runs += [a, seen]
    return len(w), items, runs


def original_spans(text: str, runs: list[int]) -> list[int]:
    """Character offsets in the original text of the runs of words."""
    if not runs:
        return []
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    return [x for a, b in zip(runs[::2], runs[1::2]) for x in (at[a][0], at[b - 1][1])]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    part_bytes: int = PART_BYTES,
) -> tuple[DataFrame, str]:
    """`docs` with a struct column (n_words, n_hit, items, runs, spans); returns it and the column's name.

    items: ids of the items with occurring windows, sorted as text. runs: hit words as flat
    half-open word numbers. spans: the same runs as character offsets of the original text.
    """
    bench = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).filter(
        "i is not null and t is not null"
    )
    total = bench.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_bytes))
    names: list[str] = []
    for p in range(parts):
        part = bench.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p) if parts > 1 else bench
        items = sorted((r.i, r.t) for r in part.distinct().toLocalIterator())
        shipped = docs.sparkSession.sparkContext.broadcast(items)

        def factory(shipped=shipped, whole=parts == 1):
            machine, outputs = _cached(shipped.value, width)

            def work(texts: list) -> list:
                rows = []
                for t in texts:
                    n, ids, runs = scan(t, machine, outputs)
                    hit = sum(runs[1::2]) - sum(runs[::2])
                    rows.append((n, hit, sorted(ids), runs, original_spans(t, runs) if whole and runs else []))
                return rows

            return work

        docs, name = map_text(docs, factory, HITS, text, "hits")
        names.append(name)
    if parts == 1:
        return docs, names[0]
    return _joined(docs, names, text)


def _joined(docs: DataFrame, names: list[str], text: str) -> tuple[DataFrame, str]:
    """The union of several parts' hits, row by row: one struct column in place of the parts'."""
    keep = [c for c in docs.columns if c not in names]
    rest = docs.select(*keep, F.struct(*names).alias(names[0]))
    out, kind, where = names[0], to_arrow_type(HITS), keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, found in zip(b.column(where).to_pylist(), b.column(len(keep)).to_pylist()):
                parts = list(found.values())
                runs: list[int] = []
                for p in parts:
                    runs = _merge(runs, p["runs"])
                hit = sum(runs[1::2]) - sum(runs[::2])
                ids = sorted({i for p in parts for i in p["items"]})
                spans = original_spans(t or "", runs)
                rows.append({"n_words": parts[0]["n_words"], "n_hit": hit, "items": ids, "runs": runs, "spans": spans})
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(rows, type=kind)], names=[*keep, out])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(out, HITS)])
    return rest.mapInArrow(run, schema), out
