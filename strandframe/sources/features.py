"""Feature tables of GenBank, EMBL and Swiss-Prot records: locations and qualifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

PART = "struct<ref:string,start0:bigint,end0:bigint,strand:string>"
FEATURE = f"struct<type:string,location:string,start0:bigint,end0:bigint,strand:string,parts:array<{PART}>,qualifiers:array<struct<key:string,value:string>>>"
#: Column at which a line's text begins, after the feature key.
MARGIN = {"genbank": 21, "embl": 21}
_TOKEN = re.compile(r"([a-z]+)\(|[(),]|[^(),]+")
_SPOT = re.compile(r"[<>?]?(\d+)")


def location_parts(text: str, strand: str = "+") -> list[tuple]:
    """(ref, start0, end0, strand) of every stretch of a location, in reading order.

    ``complement`` turns what it holds round and gives it the other strand;
    ``join``, ``order`` and ``bond`` list; ``one-of`` counts as a list too.  ``a^b`` is
    the empty stretch between two letters, ``a.b`` one letter of that range (the
    whole range is given).  Unknown places (``?``) are null; partial marks are dropped.
    """
    root: list = []
    stack = [("", root)]
    for m in _TOKEN.finditer(text):
        word, token = m.group(1), m.group(0)
        if word is not None or token == "(":
            stack.append((word or "", []))
        elif token == ")":
            if len(stack) > 1:
                kind, inner = stack.pop()
                if kind == "complement":
                    inner = [(ref, a, b, "-" if s == "+" else "+") for ref, a, b, s in reversed(inner)]
                stack[-1][1].extend(inner)
        elif token != ",":
            ref, _, span = token.strip().rpartition(":")
            gap = "^" in span
            ends = re.split(r"\.\.|\.|\^", span)
            found = [_SPOT.fullmatch(e.strip()) for e in (ends[0], ends[-1])]
            first, last = (int(f.group(1)) if f else None for f in found)
            if first is not None or last is not None:
                stack[-1][1].append((ref or None, None if first is None else first - (0 if gap else 1), None if last is None else last - (1 if gap else 0), "+"))
    for kind, inner in stack[1:]:  # brackets left open
        root.extend(inner)
    return root if strand == "+" else [(r, a, b, "-" if s == "+" else "+") for r, a, b, s in reversed(root)]


def qualifiers(text: str) -> list[tuple]:
    """(key, value) of the lines after a location; quoted values may hold ``/``, line ends and doubled quotes.

    Lines of a value are joined by a blank, those of ``translation`` by nothing.  A
    key without a value gives null.
    """
    out = []
    at = 0
    while True:
        m = re.compile(r"(?:^|\n)\s*/([^\s=/]+)(=)?").search(text, at)
        if not m:
            return out
        key, at = m.group(1), m.end()
        if not m.group(2):
            out.append((key, None))
            continue
        if text[at : at + 1] == '"':
            end = at + 1
            while end < len(text):
                if text[end] == '"':
                    if text[end + 1 : end + 2] != '"':
                        break
                    end += 1
                end += 1
            value, at = text[at + 1 : end].replace('""', '"'), end + 1
        else:
            end = re.compile(r"\n\s*/").search(text, at)
            end = end.start() if end else len(text)
            value, at = text[at:end], end
        lines = [line.strip() for line in value.split("\n")]
        out.append((key, ("" if key == "translation" else " ").join(x for x in lines if x)))


def features(lines: list[str], margin: int) -> list[dict]:
    """Features of table lines whose key stands before column ``margin`` and whose text from there on."""
    found: list[list[str]] = []
    for line in lines:
        key, text = line[5:margin].strip(), line[margin:].rstrip()
        if key:
            found.append([key, text])
        elif found and text:
            found[-1][1] += "\n" + text
    out = []
    for key, body in found:
        cut = re.compile(r"(?:^|\n)\s*/").search(body)
        where = re.sub(r"\s+", "", body[: cut.start()] if cut else body)
        parts = location_parts(where)
        own = [p for p in parts if p[0] is None]
        starts, ends = [p[1] for p in own if p[1] is not None], [p[2] for p in own if p[2] is not None]
        strands = {p[3] for p in parts}
        out.append({
            "type": key, "location": where, "start0": min(starts, default=None), "end0": max(ends, default=None),
            "strand": strands.pop() if len(strands) == 1 else ("." if strands else "+"),
            "parts": [dict(zip(("ref", "start0", "end0", "strand"), p, strict=True)) for p in parts],
            "qualifiers": [{"key": k, "value": v} for k, v in qualifiers(body[cut.start() :] if cut else "")],
        })
    return out


def old_protein_features(lines: list[str]) -> list[dict]:
    """Swiss-Prot tables with the places in columns of their own and a free description."""
    out: list[dict] = []
    for line in lines:
        m = re.match(r"FT   (\S+)\s+([<>?]?\d*)\s+([<>?]?\d*)(?:\s+(.*))?$", line)
        if m and (m.group(2) or m.group(3)):
            a, b = (_SPOT.fullmatch(m.group(k)) for k in (2, 3))
            start, end = (int(a.group(1)) - 1 if a else None), (int(b.group(1)) if b else None)
            note = (m.group(4) or "").strip()
            out.append({
                "type": m.group(1), "location": f"{m.group(2)}..{m.group(3)}", "start0": start, "end0": end, "strand": "+",
                "parts": [{"ref": None, "start0": start, "end0": end, "strand": "+"}], "qualifiers": [{"key": "note", "value": note}] if note else [],
            })
        elif out:
            more = line[5:].strip()
            note = out[-1]["qualifiers"]
            if more.startswith("/FTId="):
                note.append({"key": "id", "value": more[6:].rstrip(".")})
            elif note and more:
                note[0]["value"] += " " + more
    for f in out:
        for q in f["qualifiers"]:
            q["value"] = q["value"].rstrip(".")
    return out


def with_features(rows: DataFrame, table: str, fmt: str) -> DataFrame:
    """``rows`` with the text column ``table`` (feature lines of a record) parsed into ``features``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch[table]:
                lines = [x.rstrip("\r") for x in (text or "").split("\n") if x.strip()]
                if fmt == "embl" and any(re.match(r"FT   \S+\s+[<>?]?\d+\s+[<>?]?\d+", x) for x in lines):
                    found.append(old_protein_features(lines))
                else:
                    found.append(features(lines, MARGIN[fmt]))
            yield batch.drop(columns=table).assign(features=found)

    kept = [f for f in rows.schema.fields if f.name != table]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInPandas(run, f"{kinds}, features array<{FEATURE}>")
