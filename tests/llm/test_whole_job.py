"""Queries cover all of their input: small fixtures against brute force."""

import textwrap

import duckdb
import numpy as np
import pytest

from shelfwise.llm import graph_dedup, licenses


def test_vector_links_count_at_both_ends(spark):
    """Pairs at the borders of far more shards than the overlap; audits off, so that links are missed but none counts at one end only."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16))
    x = np.concatenate([x, x + 0.4 * rng.normal(size=x.shape)]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    for how in (graph_dedup.Graph(shard_rows=20, overlap=2, least_recall=0.0), graph_dedup.Graph(shard_rows=20, max_centers=5, part_rows=40, query_rows=30, overlap=2, least_recall=0.0)):
        got = {r.vec_id: r for r in graph_dedup.near_vectors(df, how).collect()}
        groups = np.bincount([r.component_id for r in got.values()], minlength=600)
        assert all((r.n_links > 0) == (groups[r.component_id] > 1) for r in got.values())
        assert sum(r.n_links for r in got.values()) % 2 == 0 and all(r.n_links <= links[r.vec_id].sum() for r in got.values())
    rows = graph_dedup.near_vectors(df, graph_dedup.Graph(shard_rows=20)).collect()
    found = np.array([r.n_links for r in sorted(rows)])
    has = links.any(1)
    recall = (found[has] / links.sum(1)[has]).mean()
    assert recall >= 0.98 and {r.audited_recall for r in rows} == {rows[0].audited_recall} and abs(rows[0].audited_recall - recall) < 0.03


def test_a_group_over_many_shards_is_walked_whole(spark):
    """One large group of near copies that centroids and planes part: every link counts, in double precision, without margin for floats."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=24)
    x = np.concatenate([base + 0.12 * rng.normal(size=(260, 24)), rng.normal(size=(140, 24))])
    x[399] = 1e-300 * base  # a tiny vector has its direction all the same
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    got = {r.vec_id: r for r in graph_dedup.near_vectors(df, graph_dedup.Graph(shard_rows=15, max_centers=8, part_rows=50, query_rows=40, overlap=2)).collect()}
    found, truth = np.array([got[i].n_links for i in range(400)]), links.sum(1)
    assert (found <= truth).all() and found.sum() >= 0.98 * truth.sum() and len({got[i].component_id for i in range(260)}) == 1


def full_texts():
    """Licence -> (rule, paragraphs), put together from the sentences of each licence's first rule; conditions as list items."""
    out = {}
    for licence, (_, _, rules) in licenses.LICENSES.items():
        if rules:
            name, sentences = rules[0]
            paragraphs = ["Copyright 2020 Someone. All rights reserved."]
            for k, s in enumerate(sentences):
                number = f"{k}. " if s in ("bsd_source", "bsd_binary", "bsd_names") else ""
                end = "" if licenses.SENTENCES[s].endswith((":", " v", " at")) else "."
                paragraphs.append(number + licenses.SENTENCES[s] + end + (" 2.0." if s == "mpl_subject" else ""))
            out[licence] = name, paragraphs
    return out


def wrapped(parts, between, mark="", end="\n"):
    lines = [line for p in parts for line in [*textwrap.wrap(p, 72), *between]]
    return end.join(mark + line if line else mark.rstrip() for line in lines)


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_licences_are_found(spark, mark, end):
    texts = full_texts()
    assert len(texts) == 17
    rows = [(f"{k}|{len(b)}", wrapped(p, b, mark, end)) for k, (_, p) in texts.items() for b in ([""], [])]
    got = {r.doc_id: (r.rules, r.licenses) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {i: (texts[i.split("|")[0]][0], i.split("|")[0]) for i, _ in rows}


def test_licences_inside_longer_lines_and_the_same_in_sql(spark, tmp_path):
    rows = [
        (1, "This file is Licensed under the MIT License."), (2, "Licensed under the MIT license, see LICENSE"), (3, "text\nThe code is released under the GNU General Public License v3\nmore text"),
        (4, "// SPDX-License-Identifier: BSD-3-Clause\nint main() {}"), (5, "released  under\nthe ISC License; distributed under the Zlib license!"), (6, "We license nothing. The permission is ours."),
        (7, "unlicensed under the mitt license"), (8, None), (9, ""), (10, "plain words. " * 60_000 + "Licensed under CC BY 4.0"), (11, "Licensed under CC BY-NC 4.0.\n" * 3), (11, "Licensed under CC BY-NC 4.0.\n" * 3),
    ]
    rows += [(100 + k, wrapped(p, b, m)) for k, (_, p) in enumerate(full_texts().values()) for b in ([""], []) for m in ("", " * ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.scan_licenses(df)
    got = {r.doc_id: (r.rules, r.licenses) for r in found.collect()}
    assert [got[k] for k in range(1, 12)] == [
        ("mit_reference", "MIT"), ("mit_reference", "MIT"), ("gpl3_reference", "GPL-3.0"), ("bsd3_tag", "BSD-3-Clause"), ("isc_reference,zlib_reference", "ISC,Zlib"), ("", ""), ("", ""), ("", ""), ("", ""),
        ("cc_by_reference", "CC-BY-4.0"), ("cc_by_nc_reference", "CC-BY-NC-4.0"),
    ]
    df.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    con.execute(licenses.OP2_SQL)
    assert [d[0] for d in con.description] == found.columns
    assert sorted(con.fetchall()) == sorted(tuple(r) for r in found.collect())
