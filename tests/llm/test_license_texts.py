"""License scan of altered notices, headers and whole texts."""

from strandframe.llm import license


def test_altered_notices_and_whole_texts(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    known = license.known_licenses()
    altered = {
        "MIT": ["Released under the MIT License", "released under the MIT License, and", "(“Released under the MIT License”)", "Distributed under the MIT License."],
        "Apache-2.0": ["Licensed under the Apache License Version 2.0", "Available under the [Apache License], Version 2.0;"],
        "GPL-3.0": ["This book is licensed under the GNU General Public License version 3"],
        "CC-BY-NC-4.0": ["licensed under CC BY-NC 4.0", "Shared under «CC BY-NC 4.0»"],
        "BSD-3-Clause-notice": ["Licensed under the BSD 3-Clause License"],
        "MIT-text": [known["MIT-text"].replace("Software", "Program", 1)],
        "GPL-3-text": [known["GPL-3-text"].replace("Foundation", "Society", 3)],
        "MPL-2.0-text": [known["MPL-2.0-text"]],
    }
    cases = [(name, t) for name, texts in altered.items() for t in texts]
    rows = [(i, f"{filler} {t} {filler}") for i, (_, t) in enumerate(cases)] + [(100, f"{filler} Released under the Apache licence {filler}"), (101, "of the and to in or is by a " * 50)]
    got = {r.doc_id: r.licenses for r in license.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(name, t[:60]) for i, (name, t) in enumerate(cases) if name not in got[i]] == []
    assert got[100] == got[101] == []
    assert "MIT" not in got[4] and "GPL-3.0" not in got[8]


def test_every_known_template_is_found(spark):
    known = license.known_licenses()
    rows = [(i, f"x y z. {t}") for i, t in enumerate(known.values())]
    got = {r.doc_id: r.licenses for r in license.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [name for i, name in enumerate(known) if name not in got[i]] == []
