"""Identifiers, expressions, denials and spellings of notices; the same in SQL."""

import duckdb

from shelfwise.llm import licenses

TEXTS = {
    "SPDX-License-Identifier: MIT-0": "", "SPDX-License-Identifier: BSD-2-Clause-Patent": "", "Not licensed under the MIT License": "", "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT", "Licensed under GPL-3.0": "GPL-3.0",
    "Released under the MIT licence": "MIT", "This is licensed under the terms of the MIT license.": "MIT", "SPDX-License-Identifier: (GPL-2.0-only AND BSD-3-Clause) OR MIT": "MIT,GPL-2.0,BSD-3-Clause",
    "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0": "GPL-2.0", "SPDX-License-Identifier: MIT\nint x;": "MIT", "It is no longer released under the Apache License 2.0": "", "SPDX-License-Identifier: MIT-0 OR ISC": "ISC",
    "You may use MIT or Apache-2.0 licensed code": "", "SPDX-License-Identifier: BSD-3-Clause-Clear": "", "Software never distributed under the ISC License": "", "Available under the terms of the Mozilla Public Licence 2.0": "MPL-2.0",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "The mit 0 project is not MIT licensed": "",
}


def test_notices_and_tags(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = licenses.scan_licenses(df)
    rows = found.collect()
    got = {list(TEXTS)[r.doc_id]: r.licenses for r in rows}
    assert {k: v for k, v in got.items() if v != TEXTS[k]} == {}
    df.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    con.execute(licenses.OP2_SQL)
    assert sorted(con.fetchall()) == sorted(tuple(r) for r in rows)


def test_the_pattern_is_that_of_all_known_sentences():
    import re

    words = ["a b", "a b c", "a", "b c", "bc d"]
    pattern = re.compile(rf"\b({licenses._trie(words)})\b")
    for text in ("a b c d", "a b d", "x a y", "bc d e", "b c", "ab c", "a bc"):
        longest = re.compile(rf"\b({'|'.join(sorted(words, key=len, reverse=True))})\b")
        assert pattern.findall(text) == longest.findall(text)
