import datetime, sys
sys.path.insert(0, str(__import__("pathlib").Path(__file__).parents[2]))
import pytest
from corpusmill.llm import licenses as L
from pyspark.sql import SparkSession

REFS = [("MIT", "MIT License", "anyone may take this wonderful code and run with it as long as the notice stays on it"), ("Apache-2.0", "Apache License, Version 2.0", "every contributor hands over patents and rights while changed files must carry a remark saying so"), ("GPL-2.0-only", "GNU General Public License, version 2", "pass it on under these same terms with all of its source or do not pass it on at all"), ("BSD-3-Clause", "BSD 3-Clause License", "keep notice terms and disclaimer and never use our names for promotion of derived work"), ("ISC", "ISC License", "use copy change for any purpose if the grant shows in each and every copy of this software")]
R = L.References(REFS)


@pytest.mark.parametrize("name, want", [("MIT", "MIT"), ("Expat (MIT)", "MIT"), ("the MIT license", "MIT"), ("ASL 2.0", "Apache-2.0"), ("GPLv2", "GPL-2.0-only"), ("GNU GPL version 2", "GPL-2.0-only"), ("New BSD License", "BSD-3-Clause"), ("GPL 3", None), ("a MIT course", None), ("the intranet", None)])
def test_names(name, want):
    assert L.license_of_name(name, R.ids) == want


@pytest.mark.parametrize("text, want", [
    ("// SPDX-License-Identifier: MIT OR GPL-2.0-only\nx", {"GPL-2.0-only OR MIT"}),
    ("/*\n * Licensed under Apache License, Version 2.0 or MIT License, at your option.\n */\nx", {"Apache-2.0 OR MIT"}),
    ("# Anyone may take this wonderful\n#   code and run with it AS LONG as the\n# notice stays on it.\ncode", {"MIT"}),
    ("# recognises MIT and BSD headers in other trees\n", set()), ("# license server timeout\n", set()),
    ("x = 1\n# SPDX-License-Identifier: MIT\n", set()), ("", set()), ("__license__ = 'ISC'\n", {"ISC"}),
    ("// SPDX-License-Identifier: MIT\r\n// Use of this file is governed by GPLv2; see the file\r\n", {"MIT", "GPL-2.0-only"}),
])
def test_headers(text, want):
    assert L.of_file("header", "a.py", text, R) == want


def test_altered():
    (i, coverage, ops), = [x for x in R.aligned("keep notice terms and the disclaimer and always use our names for promotion of derived work") if x[0] == "BSD-3-Clause"]
    assert 0.8 < coverage < 1 and ("replace", "never", "always") in ops


def test_aligned_at_every_place():
    """The whole text stands between many stray pieces of it, far from those that windows at some of the hits would cover."""
    body = REFS[0][2]
    piece = " ".join(body.split()[:3])
    stray = lambda n: f"{piece} {'filler ' * 80}" * n
    for before in range(60, 80):
        got = {i: c for i, c, _ in R.aligned(f"{stray(before)} {body} {'filler ' * 80} {stray(150 - before)}")}
        assert got["MIT"] == 1


def test_title_below_the_first_lines():
    assert L.of_file("root", "LICENSE", "Copyright of all\nwho\nwrote\nthis\nhere\n\nMIT License\n", R) == {"MIT"}


def test_tables(tmp_path):
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    t = datetime.datetime(2024, 1, 1)
    files = [(1, 1, "a.py", "python", "x", t), (2, 1, "LICENSE", None, "MIT License\n\n" + REFS[0][2], t), (2, 1, "LICENSE", None, "MIT License\n\n" + REFS[0][2], t), (3, 1, "b.py", "python", "# SPDX-License-Identifier: ISC\n", t),
             (4, 2, "c.py", "python", None, t), (5, 2, "third_party/x/LICENSE", None, REFS[1][2], t), (6, 3, "package.json", None, '{\n "license": "Apache-2.0"\n}', t), (7, 3, "COPYING", None, REFS[2][2], t), (8, 3, "d.go", "go", "", t),
             (9, None, "e.go", "go", "// License: MIT\n", t), (None, 1, "f.go", "go", "x", t), (10, 3, None, None, "x", t)]
    spark.createDataFrame([(*x, "extra") for x in files], "file_id long, repo_id long, path string, language string, content string, arrived_at timestamp, license string").write.parquet(f"{tmp_path}/prepared_files.parquet")
    spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "repo_id long, license string").write.parquet(f"{tmp_path}/repos.parquet")
    spark.createDataFrame(REFS, "license_id string, title string, body string").write.parquet(f"{tmp_path}/license_refs.parquet")
    got = {(r.scope, r.id): (r.license, r.flag) for r in L.p4_found(spark, str(tmp_path)).collect()}
    assert got == {("repo", 1): ("MIT", "ok"), ("repo", 2): ("UNKNOWN", "unknown"), ("repo", 3): ("Apache-2.0|GPL-2.0-only", "conflict"), ("repo", 4): ("UNKNOWN", "unknown"),
                   ("file", 1): ("MIT", "ok"), ("file", 3): ("ISC", "conflict"), ("file", 4): ("UNKNOWN", "unknown"), ("file", 8): ("Apache-2.0|GPL-2.0-only", "conflict"), ("file", 9): ("MIT", "ok")}
    assert {r.license_id for r in L.p4_matches(spark, str(tmp_path)).collect()} == {"MIT", "Apache-2.0", "GPL-2.0-only"}
