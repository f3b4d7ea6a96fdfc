"""License scans: MinHash bands over overlapping text windows, then exact shingle containment."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm.license_notices import HEADERS, NAMES, SHORT
from strandframe.llm.words import WordHash, grams, scramble

#: Notices to look for.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction"
    ),
}
#: Everything that is no letter or digit in ASCII; the general punctuation and Latin-1 signs of UTF-8.
PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
SIGNS = re.compile(rb"\xe2\x80[\x80-\xbf]|\xc2[\xa0-\xbf]")


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words without punctuation: marks at, in or between words part them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return SIGNS.sub(b" ", raw).translate(PLAIN).lower().split()


def known_licenses() -> dict[str, str]:
    """Notices, headers and whole license texts by template id."""
    folder = resources.files("strandframe.llm") / "license_texts"
    whole = {f"{f.name.removesuffix('.txt')}-text": f.read_text("utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}
    return NOTICES | SHORT | HEADERS | whole


def bands_for(similarity: float, miss: float) -> int:
    """One-coordinate bands that make windows of this similarity collide with probability above ``1 - miss``."""
    return math.ceil(math.log(miss) / math.log1p(-similarity))


def shingle_size(length: int, n: int, containment: float) -> int:
    """Largest size up to ``n`` at which one changed word, which breaks so many shingles, still leaves the containment."""
    return max(1, min(n, int((length + 1) * (1 - containment) / (2 - containment) + 1e-9)))


class Group:
    """Templates of one word count and one count of distinct shingles with their band keys."""

    def __init__(self, length: int, shingle: int, distinct: int, containment: float, miss: float):
        self.shingle, self.size = shingle, max(1, length - shingle + 1)
        self.block = math.ceil(1.5 * self.size)
        need = math.ceil(containment * distinct - 1e-9)
        bands = bands_for(need / (2 * self.block + distinct - need), miss)
        self.odd = scramble(np.arange(1, bands + 1, dtype=np.uint64)) | np.uint64(1)
        self.items: list[tuple[str, np.ndarray]] = []
        self.table: dict[int, set[int]] = {}
        self.names: list[list[tuple[int, int]]] = []

    def add(self, name: str, shingles: np.ndarray, phrases: list[tuple[int, int]]) -> None:
        for key in self._keys(shingles[None, :]).ravel().tolist():
            self.table.setdefault(key, set()).add(len(self.items))
        self.items.append((name, shingles))
        self.names.append(phrases)

    def _keys(self, windows: np.ndarray) -> np.ndarray:
        """Band keys (windows x bands) of rows of shingles; the band number is mixed into the key."""
        out = np.empty((len(windows), len(self.odd)), np.uint64)
        for b, odd in enumerate(self.odd):
            out[:, b] = (windows * odd).min(axis=1) ^ odd
        return out

    def matches(self, g: np.ndarray, containment: float) -> Iterator[tuple[str, float]]:
        """Templates found in the shingles ``g`` of a text, with their containment in one window."""
        if not len(g):
            return
        pad = -len(g) % self.block
        blocks = np.concatenate([g, np.full(pad, g[-1])]).reshape(-1, self.block)
        windows = np.concatenate([blocks[:-1], blocks[1:]], axis=1) if len(blocks) > 1 else blocks
        keys = self._keys(windows)
        at, _ = np.nonzero(met := np.isin(keys, self.known))
        pairs = {(w, k) for w, key in zip(at.tolist(), keys[met].tolist(), strict=True) for k in self.table[key]}
        for w, k in pairs:
            name, t = self.items[k]
            share = float(np.isin(t, windows[w]).mean())
            if share >= containment:
                yield name, share

    @property
    def known(self) -> np.ndarray:
        return np.fromiter(self.table, np.uint64, len(self.table))


class Screen:
    """Which templates hold enough shingles in a whole text to be in one of its windows; loses none."""

    def __init__(self, groups: list[Group], containment: float):
        items = [(g, k, group) for g, group in enumerate(groups) for k in range(len(group.items))]
        self.need = np.array([math.ceil(containment * len(group.items[k][1]) - 1e-9) for _, k, group in items], np.int64)
        self.where = [(g, k) for g, k, _ in items]
        self.parts = []
        for n in sorted({group.shingle for group in groups}):
            mine = [(i, group.items[k][1]) for i, (_, k, group) in enumerate(items) if group.shingle == n]
            shingles, owner = np.concatenate([s for _, s in mine]), np.concatenate([np.full(len(s), i) for i, s in mine])
            order = np.argsort(shingles, kind="stable")
            known, first = np.unique(shingles[order], return_index=True)
            self.parts.append((n, known, np.append(first, len(order)), owner[order]))

    def passed(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(group, item) of the templates that may be in the text of word hashes ``h``."""
        held = np.zeros(len(self.need), np.int64)
        for n, known, first, owner in self.parts:
            g = grams(h, n)
            if len(g):
                at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                for i in np.unique(at[known[at] == g]).tolist():
                    held[owner[first[i] : first[i + 1]]] += 1
        return [self.where[i] for i in np.flatnonzero(held >= self.need)]


def licenses(
    docs: DataFrame, templates: DataFrame | None = None, n: int = 3, containment: float = 0.8, miss: float = 1e-6, block_bytes: int = 8 << 20
) -> DataFrame:
    """doc_id, licenses (sorted template ids), n_licenses, best (largest containment) for every row of ``docs`` (doc_id, text).

    Templates (template_id, text) are read in blocks of about ``block_bytes``; without
    any, those of ``known_licenses``.  Words are taken without punctuation.  Shingles
    have ``n`` words, fewer for a short template, so that one changed word leaves
    enough of them.  Only templates with enough shingles anywhere in the text go on:
    a text's shingles are cut into blocks of one and a half template lengths and
    two neighbouring blocks are a window, so windows overlap by half and every
    occurrence lies whole in one.  The band count follows from the least similarity
    of such a window.  A window that meets a template in a band is verified by
    exact containment of the template's distinct shingles.  Known templates that differ
    from others by a name alone also need that name in the text.  Texts shorter than a
    template's shingle cannot hold it.  Null and wordless texts have no licenses;
    null or wordless templates match nothing; repeated template ids count once.
    """
    spark: SparkSession = docs.sparkSession
    names = {} if templates is not None else NAMES
    if templates is None:
        templates = spark.createDataFrame(list(known_licenses().items()), "template_id string, text string")
    total = templates.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    out = docs.select("doc_id", "text", F.array().cast("array<string>").alias("licenses"), F.lit(0.0).alias("best"))
    for b in range(n_blocks):
        block = templates.where(F.pmod(F.xxhash64("template_id", "text"), F.lit(n_blocks)) == b).collect()
        shared = spark.sparkContext.broadcast([(r["template_id"], r["text"]) for r in block])  # at most about block_bytes

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            cache, by_length = WordHash(), {}
            for name, text in shared.value:
                words = plain_words(text)
                if words and name is not None:
                    size = shingle_size(len(words), n, containment)
                    shingles = np.unique(grams(cache.of(words), size))
                    kind = (len(words), len(shingles))
                    if kind not in by_length:
                        by_length[kind] = Group(len(words), size, len(shingles), containment, miss)
                    phrases = [cache.of(plain_words(p)) for p in names.get(name, "").split("|") if p]
                    by_length[kind].add(name, shingles, [(len(h), int(grams(h, len(h))[0])) for h in phrases])
            groups = list(by_length.values())
            screen = Screen(groups, containment)
            for batch in batches:
                found, best = [set(x) for x in batch["licenses"]], batch["best"].tolist()
                words_of = WordHash()
                for d, text in enumerate(batch["text"]):
                    h = words_of.of(plain_words(text))
                    open_groups: dict[int, set[str]] = {}
                    for g, k in screen.passed(h):
                        if all((grams(h, size) == np.uint64(phrase)).any() for size, phrase in groups[g].names[k]):
                            open_groups.setdefault(g, set()).add(groups[g].items[k][0])
                    for g, wanted in open_groups.items():
                        for name, share in groups[g].matches(grams(h, groups[g].shingle), containment):
                            if name in wanted:
                                found[d].add(name)
                                best[d] = max(best[d], share)
                yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": batch["text"], "licenses": [sorted(x) for x in found], "best": best})

        out = out.mapInPandas(scan, "doc_id long, text string, licenses array<string>, best double")
    return out.select("doc_id", "licenses", F.size("licenses").cast("long").alias("n_licenses"), "best")
