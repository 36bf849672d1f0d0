"""Licence notices inside longer texts, against SQL without pruning."""

import duckdb
import pandas as pd

from sparkloom.llm import license_scan

MIT, APACHE, GPL = (next(t for n, t in license_scan.TEMPLATES if n == name and len(t) > 300) for name in ("MIT", "Apache-2.0", "GPL-3.0"))
CODE = "\n".join(f"def step_{i}(state, value):\n    return state * value + {i}" for i in range(40))


def wrapped(text, mark, width=11):
    words = text.split()
    return "\n".join(mark + " ".join(words[i : i + width]) for i in range(0, len(words), width))


ROWS = [
    (1, MIT.replace(". ", ".\n\n") + "\n\n" + CODE, {"MIT"}),
    (2, "/*\n" + wrapped(APACHE, " * ") + "\n */\n" + CODE, {"Apache-2.0"}),
    (3, "#!/bin/sh\n# Copyright someone\n" + wrapped(MIT, "# ") + "\n" + CODE, {"MIT"}),
    (4, "A small tool. This work is licensed under the GNU General Public License, version 3. Have fun with it and tell others.", {"GPL-3.0"}),
    (5, CODE + "\n" + GPL + " " + CODE, {"GPL-3.0"}),
    (6, "the license of the software is not said here, and the rights to use it are unknown " * 30, set()),
    (7, CODE, set()),
    (8, None, set()),
    (9, "", set()),
    (10, "licensed", set()),
    (11, CODE + wrapped(MIT, "// ") + CODE + wrapped(APACHE, "// "), {"MIT", "Apache-2.0"}),
    (11, "Released under the MIT License. Released under the MIT License.", {"MIT"}),
    (12, MIT.replace("Software", "Programme").replace("copies", "duplicates") + CODE, None),
]


def test_notices_inside_texts(spark):
    df = license_scan.scan(spark.createDataFrame([(i, t, "x") for i, t, _ in ROWS], "doc_id long, text string, license string"))
    rows = df.collect()
    found = {i: {r.license for r in rows if r.doc_id == i} for i, _, _ in ROWS}
    for i, _, want in ROWS:
        # Notices that differ in a version or a word are alike by any such measure; the best is the one that is there.
        if want is not None:
            best = max((r.dice for r in rows if r.doc_id == i), default=0)
            assert want <= found[i] and bool(want) == bool(found[i]), (i, found[i])
            assert i == 11 or {r.license for r in rows if r.doc_id == i and r.dice == best} == want
    assert found[11] == {"MIT", "Apache-2.0"}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, t) for i, t, _ in ROWS], columns=["doc_id", "text"]))
    result = con.sql(license_scan.scan_sql())
    assert df.columns == result.columns
    assert sorted(map(tuple, rows)) == sorted(result.fetchall())
