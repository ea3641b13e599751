"""The operators of the llm subpackage on small fixtures: brute force, round trips, defined cases."""

import bisect
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convan.llm import binpack, components, exact_dedup, licences, near_dedup, neighbours, packing, pieces, quality, toxicity, warc
from convan.llm.common import new_path

BASE = " ".join(f"w{i}" for i in range(60))
NEAR = BASE.replace("w30", "other")
ROWS = [(1, BASE), (2, NEAR), (3, BASE), (4, None), (5, ""), (6, "one two"), (7, "one two"), (8, "some quite different words that stand alone here"), (9, "long " * 4000 + BASE), (9, "long " * 4000 + BASE)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, score string, component_id int")


def test_exact_dedup_rounds(spark):
    """Any number of runs that meet in a round gives the same, with a text on a third of all rows, null and repeated ids."""
    rows = [(i if i % 11 else None, "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"t{i % 50}")) for i in range(900)] + [(5, "t5")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups: dict[str, list] = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    best = {x: max((i for i in ids if i is not None), default=None) for x, ids in groups.items()}
    want = sorted(((i, best[x or ""], len(groups[x or ""]), i == best[x or ""], hashlib.sha256((x or "").encode()).hexdigest()) for i, x in rows), key=str)
    for bits, ways in ((6, 3), (5, 2), (2, 4), (3, 1)):
        got = exact_dedup.exact_dedup(df, keep="max", bits=bits, ways=ways).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=str) == want, (bits, ways)


def test_exact_dedup(docs):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, keep="max").collect()}
    assert got == {(1, 3, 2, False), (3, 3, 2, True), (2, 2, 1, True), (4, 5, 2, False), (5, 5, 2, True), (6, 7, 2, False), (7, 7, 2, True), (8, 8, 1, True), (9, 9, 2, True)}
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_near_dedup(docs):
    got = {r.doc_id: (r.component_id, r.kept, r.n_shingles) for r in near_dedup.near_dedup(docs).collect()}
    assert got[1] == (1, True, 56) and got[2][0] == 1 and got[3][0] == 1
    assert got[4] == (4, True, 0) and got[5] == (5, True, 0) and got[6] == (6, True, 1) and got[7][0] == 6 and got[9][0] == 1  # 56 of its 61 distinct shingles
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0


def test_near_dedup_brute_force(spark):
    rng = np.random.default_rng(0)
    texts = []
    for _ in range(12):
        base = [f"t{x}" for x in rng.integers(0, 500, 80)]
        for _ in range(6):
            words = list(base)
            for at in rng.integers(0, 80, rng.integers(0, 5)):
                words[at] = f"n{rng.integers(0, 10**6)}"
            texts.append(" ".join(words))
    sets = [set(near_dedup.shingle_set(t).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = near_dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: root(i) for i in range(len(texts))}


def test_components(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8), (7, 7), (5, 4)], "a long, b long")
    assert {(r.node, r.component) for r in components.components(edges).collect()} == {(i, 1) for i in range(1, 6)} | {(8, 8), (9, 8)}


def test_best_fit_decreasing():
    rng = np.random.default_rng(1)
    lengths = [*rng.integers(1, 4097, 500).tolist(), *[700] * 100, *[4096] * 5]
    open_, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(open_, x)
        left = open_.pop(i) if i < len(open_) else 4096
        n += left == 4096
        if left > x:
            bisect.insort(open_, left - x)
    rules = packing.best_fit_rules(Counter(lengths))
    assert len({s for _, _, _, s, o in rules.tolist() if o == 0}) <= n


def test_packing(docs):
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.offset == got.groupby("sequence_id").length.cumsum() - got.length).all() and got.groupby("sequence_id").length.sum().max() <= 4096
    empty = got[got.doc_id == 4].iloc[0]
    assert (empty.length, empty.ids_crc32) == (1, zlib.crc32(b"\x01\0\0\0"))
    assert packing.pack(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_word_tokenizer_equals_library():
    w = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["I'm x<|endoftext|>y don't", "É é ÀÀ it's 123 ½", "a\x1cb c\x85d　e", "", "Word, word; WORD!!! (x)"]
    ids, ends = w.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [w.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_equal_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["", "  a  b\tc\nd ", "日本語 😀 x", "aaaaaaaaaaa bbbb", "▁▁ x▁y", "a" * 700, "hello\0world", "naïve café … “quotes”", BASE]
    mine, coder = pieces.PieceCoder(path).encode(pa.array([*texts, None])), pieces.PieceCoder(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in mine[:-1]] == sentencepiece.SentencePieceProcessor(model_file=path).encode(texts) and mine[-1] is None
    assert [coder.decode(x) for x in mine] == [*(t.replace("▁", " ") for t in texts), None]


def test_warc(spark):
    pages = spark.createDataFrame([(1, "u", "a\r\n\r\nb"), (2, None, "a\r\n\r\nb"), (3, "x y", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n")], "page_id long, url string, html string")
    path = new_path(spark, "t")
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path)
    assert {(r.id, r.record_type, r.refers_to, r.bytes) for r in warc.resolved(records).collect()} == {(1, "revisit", 2, 6), (2, "response", None, 6), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 12)}
    assert {r.id: bytes(r.payload) for r in records.collect()}[2] == b"a\r\n\r\nb"


def test_sharding(docs):
    got = binpack.shard(docs, 3).toPandas()
    assert len(got) == len(ROWS) and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert binpack.shard(docs.limit(0), 3).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 8)).astype("float32")
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 8), (9003, [float("nan")] * 8), (9004, [1.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).toPandas()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = {i: set(np.argsort(-s[i])[:5].tolist()) for i in range(0, 1500, 50)}
    assert np.mean([len(true[i] & set(g.vec_id)) / 5 for i, g in got.groupby("query_id")]) >= 0.9 and set(got.query_id) == set(true)


def test_licences(docs, spark):
    texts = [(1, "Hello there.\nReleased under the MIT License."), (2, "All rights reserved. Licensed under the Apache License, Version 2.0."), (3, None), (4, "MIT is a place.")]
    got = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "Apache-2.0,proprietary", 3: "", 4: ""}


MIT = """The MIT License (MIT)

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
(2) Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


def test_licences_wrapped(spark):
    said = lambda text, sign: "\n".join(f"{sign}{x}" for x in text.split("\n"))
    texts = {
        "mit": MIT, "mit crlf": said(MIT, " * ").replace("\n", "\r\n"), "mit decorated": said(MIT, "#" * 300 + " "), "bsd": BSD, "bsd comment": said(BSD, "// "),
        "gpl": GPL, "gpl old": said(GPL, ";; ").replace("software:", "software;"), "gpl line": GPL.replace("\n", " "), "title": "x\nMIT License\ny", "list": "Licences: Released under the MIT License; all rights reserved\nx",
        "apart": GPL.replace("General\n", "General").replace("modify\n", "modify\n\n"), "stop": GPL.replace("modify\n", "modify.\n"), "inside": "He said this is not released under the MIT License.",
    }
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licences.scan(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    mit, gpl = ("mit-ref mit-grant mit-notice", "MIT"), ("gpl3-grant", "GPL-3.0")
    bsd = ("reserved bsd-grant bsd-source bsd-binary bsd-name", "BSD-3-Clause,BSD-2-Clause,proprietary")
    want = {"mit": mit, "mit crlf": mit, "mit decorated": mit, "bsd": bsd, "bsd comment": bsd, "gpl": gpl, "gpl old": gpl, "gpl line": gpl, "title": ("mit-ref", "MIT"), "list": ("mit-ref reserved", "MIT,proprietary")}
    assert got == want | dict.fromkeys(("apart", "stop", "inside"), ("", ""))


MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
LGPL = GPL.replace("program is", "library is").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")
SAID = {
    "mpl": (MPL, "MPL-2.0"), "isc": (ISC, "ISC"), "0bsd": (ISC.split(", provided")[0] + ".", "0BSD"), "lgpl": (LGPL, "LGPL-2.1"), "unlicense": ("// This is free and unencumbered\n// software released into the public domain.", "Unlicense"),
    "project": ("This project is licensed under the terms of the MIT License, see the LICENSE file for details.", "MIT"), "epl": ("a) Made available under the Eclipse Public License v2.0", "EPL-2.0"), "agpl": ("x\nReleased under AGPLv3 or later!\ny", "AGPL-3.0"),
    "cc": ("This work is licensed under a Creative Commons\nAttribution-ShareAlike 3.0 Unported License.", "CC-BY-SA-3.0"), "apache": ('Licensed under the Apache License, Version 2.0 (the "License")', "Apache-2.0"), "title": ("# PostgreSQL License #", "PostgreSQL"),
    "tag": ("/* SPDX-License-Identifier: MIT */", "MIT"), "tags": ("# SPDX-License-Identifier: (Apache-2.0 OR gpl-2.0-or-later) AND Unknown-1\n# spdx-license-identifier: ISC", "Apache-2.0,ISC,GPL-2.0"), "no tag": ("SPDX-License-Identifier: MITX", ""),
    "two": ("Released under the ISC License.\nReleased under the ISC License. Licensed under the zlib license", "ISC,Zlib"), "inside": ("He said it was released under the ISC license once.", ""), "other": ("Released under the Foo License.", ""), "none": (None, ""), "empty": ("", ""),
}


def test_licences_named_and_in_sql(spark):
    """References, texts, titles and tags, wrapped or not; the SQL finds the same, on the wrapped texts of the test before too."""
    import duckdb

    from convan.llm import queries

    texts = {k: t for k, (t, _) in SAID.items()} | {f"{k} {sign}": "\n".join(f"{sign}{x}" for x in t.split("\n")) for k, t in (("MIT", MIT), ("BSD", BSD), ("GPL", GPL)) for sign in ("", " * ", "## ", "x")}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    rows = licences.scan(df).collect()
    assert {r.doc_id: r.licences for r in rows if r.doc_id in SAID} == {k: name for k, (_, name) in SAID.items()}
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert {tuple(r) for r in rows} == set(con.sql(queries.ORACLE_SQL["op3_licences"]).fetchall())


def test_licence_tables():
    """Each sentence passes the filter, each identifier is in a rule, and each name is found in a reference around it."""
    import re

    hints = "|".join(licences.HINTS)
    known = licences.SENTENCES | licences.TITLES | licences.NAMES
    assert [x for x in (*licences.SENTENCES, *licences.TITLES, *(f"released under {n}" for n in licences.NAMES)) if not re.search(hints, x)] == []
    used = {i for some in licences.RULES.values() for rule in some for i in rule}
    assert set(known.values()) - used == {"mpl2-copy", "zlib-notice"} and len(known) == 494
    assert [n for n in licences.NAMES if re.fullmatch(licences.REFERENCE, f"this project is released under the {n} see license for details")[1] != n] == []


def test_licences_match_duckdb(spark):
    import duckdb

    from convan.llm import queries

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    got = {tuple(r) for r in queries.op3_licences(spark, "/root/testdata/sf0.01").collect()}
    assert got == set(con.sql(queries.ORACLE_SQL["op3_licences"]).fetchall())


def test_toxicity_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " scum ": 3.0}, [" pond scum "])
    assert lexicon.feature("you 1d10t!")[1] == 1 and lexicon.feature("an іdіоt")[1] == 1 and lexicon.feature("pond scum")[1] == 0 and lexicon.feature(None) == (0.0, 0)


def test_toxicity_folding_of_signs():
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " scumm": 3.0}, [])
    clear = ("idiot", "¡idiot!", "¿idiot?", "«idiot»", "‹idiot›", "·idiot·", "idiot。", "、idiot，", "「idiot」", "😀idiot", "idiot😀", "❤\ufe0fidiot", "idiot👩\u200d💻", "x…idiot—y", "idiot\u3000x", "＿idiot＿", "idiot\x85x", "\u202eidiot\u202c", "id\u200biot", "idio\u0301t", "i\u0336d\u0336iot", "id\xadiot")
    assert [x for x in clear if lexicon.feature(x)[1] != 1] == [] and lexicon.feature("«scummy")[1] == 1
    assert toxicity.fold("日本語 हिन्दी x²").split()[0] == "日本語" and len(toxicity.fold("हिन्दी की").split()) == 2
    assert [x for x in ("idiotа", "éidiot", "idiotです") if lexicon.feature(x)[1]] == []


def test_classifiers_held_out(spark):
    d = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    apart = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality.fit(documents, labels.where(~apart))
    got = documents.withColumn("s", quality.score(documents, model)).join(labels.where(apart), "doc_id").toPandas()
    assert ((got.s >= 0.7) == (got.quality == 1)).mean() >= 0.9
    lexicon = toxicity.fit(documents, labels.where(~apart))
    got = documents.withColumn("s", toxicity.score(documents, lexicon)).join(labels.where(apart), "doc_id").toPandas()
    assert ((got.s >= 0.5) == (got.toxic == 1)).mean() >= 0.9 and ((got.s >= 0.5) & (got.toxic == 0)).sum() == 0


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 16)
    text = {i: f"{i} " + "x" * (20 if i % 3 == 0 else 5_000 if i % 3 == 1 else 70_000) for i in range(60)}
    path = f"file://{tmp_path}/archives"
    warc.write_archives(spark.createDataFrame([(i, None, t) for i, t in text.items()], "page_id long, url string, html string").coalesce(1), path)
    assert {r.id: bytes(r.payload).decode() for r in warc.read_archives(spark, path).collect()} == text
    files = list((tmp_path / "archives").glob("part-*"))
    for f in files:
        import gzip

        sizes = [len(p) for _, p in warc.parse(gzip.decompress(f.read_bytes()))]
        assert len(sizes) == 1 or sum(sizes) <= 1 << 16
    assert len(files) >= 22


def test_archives_follow_the_format(spark, tmp_path):
    """A gzip member a record, warcinfo first, HTTP messages; null and repeated ids, empty payloads, no rows."""
    import gzip

    pages = [(1, "u", "é\r\n\r\n"), (1, "u", "é\r\n\r\n"), (None, "v", "é\r\n\r\n"), (None, None, "alone"), (3, "a b", None), (4, "x", "")]
    schema, path = "page_id long, url string, html string, payload int", f"file://{tmp_path}/a"
    warc.write_archives(spark.createDataFrame([(*p, 0) for p in pages], schema), path)
    records, types = [], []
    for f in (tmp_path / "a").glob("part-*"):
        members = list(warc.members(f.read_bytes()))
        assert b"".join(members) == gzip.decompress(f.read_bytes())
        types += [m.split(b"\r\n")[1].decode() for m in members[:1]]
        assert all(len(list(warc.parse(m))) == 1 for m in members[1:])
        records += [(h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Refers-To"), h["WARC-Target-URI"], p.decode()) for m in members[1:] for h, p in warc.parse(m)]
        assert all(h["Content-Type"].startswith("application/http") and b"\r\n\r\nHTTP/1.1 200 OK\r\n" in m for m in members[1:] for h, _ in warc.parse(m))
    assert set(types) == {"WARC-Type: warcinfo"}
    one = ("response", "<urn:page:1>", None, "u", "é\r\n\r\n")
    want = [one, one, ("revisit", "<urn:page:null>", "<urn:page:1>", "v", ""), ("response", "<urn:page:null>", None, "", "alone"), ("revisit", "<urn:page:3>", "<urn:page:4>", "a%20b", ""), ("response", "<urn:page:4>", None, "x", "")]
    assert sorted(records, key=str) == sorted(want, key=str)
    got = warc.resolved(warc.read_archives(spark, path)).collect()
    assert sorted([(r.id, r.bytes, r.record_type, r.refers_to) for r in got], key=str) == sorted([(1, 6, "response", None), (1, 6, "response", None), (None, 6, "revisit", 1), (None, 5, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None)], key=str)
    warc.write_archives(spark.createDataFrame([], schema), path + "0")
    assert warc.resolved(warc.read_archives(spark, path + "0")).count() == 0


def test_shards_are_even_over_many_levels_of_cells(spark, monkeypatch):
    import random

    monkeypatch.setattr(binpack, "CELL_ROWS", 15)
    monkeypatch.setattr(binpack, "FAN", 4)
    monkeypatch.setattr(binpack, "LARGE", 2)
    draw = random.Random(3)
    rows = [(i, f"{i} " + "a b " * draw.randint(1, 60)) for i in range(2_000)]
    got = binpack.shard(spark.createDataFrame(rows, "doc_id long, text string"), 5).toPandas()
    assert sorted(got["doc_id"]) == list(range(2_000))
    bytes_ = got.groupby("shard")["size"].sum()
    assert len(bytes_) == 5 and bytes_.max() - bytes_.min() < 0.02 * bytes_.mean()
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard")["slot"])


def test_fits_take_a_bounded_number_of_rows(spark, monkeypatch):
    """One labelled id on many rows: copies fit once, and no more rows come back than the parameter says."""
    rows = [(1, f"a toxic idiot text {i % 40}") for i in range(4000)] + [(2, "some clean words here")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    sizes = []
    network, calibrate = quality.Network.__init__, toxicity.Lexicon.calibrate
    monkeypatch.setattr(quality.Network, "__init__", lambda self, x, y: (sizes.append(len(x)), network(self, x, y))[1])
    monkeypatch.setattr(toxicity.Lexicon, "calibrate", lambda self, x, y: (sizes.append(len(x)), calibrate(self, x, y))[1])
    quality.fit(docs, labels)
    toxicity.fit(docs, labels)
    monkeypatch.setattr(quality, "FIT_ROWS", 10)
    monkeypatch.setattr(toxicity, "FIT_TOXIC", 7)
    quality.fit(docs, labels)
    toxicity.fit(docs, labels)
    assert sizes == [41, 41, 10, 8]


def test_toxic_hits_by_string_search(spark):
    """The automaton's hits, exceptions and all, against looking for every term at every place of the folded text."""
    rng = np.random.default_rng(2)
    terms, calm = {" idiot ": 3.0, " scum ": 2.0, " mor": 1.5, " stup": 1.0, " 𝐱": 1.0}, [" pond scum ", " stupid o clock ", " moral "]
    words = ["idiot", "1d10t", "scum", "pond", "moron", "moral", "stupid", "o", "clock", "fine", "ідіот", "s t u p i d", "S.C.U.M", "𝐢𝐝𝐢𝐨𝐭", "mörön", ",", "x"]
    lexicon = toxicity.Lexicon({toxicity.fold(t.strip())[: len(t)] if t.strip() == "𝐱" else t: w for t, w in terms.items()}, calm)
    for _ in range(300):
        text = " ".join(rng.choice(words, rng.integers(1, 12)))
        folded = toxicity.fold(text)
        at = lambda t: [i for i in range(len(folded)) if folded.startswith(t, i)]
        quiet = [(i, i + len(c)) for c in calm for i in at(c)]
        weights = [w for t, w in lexicon.weights.items() for i in at(t) if not any(a <= i and i + len(t) <= b for a, b in quiet)]
        x, hits = lexicon.feature(text)
        want = np.log1p(sum(weights)) / 2 + np.log1p(100 * sum(weights) / (folded.count(" ") + 21)) / 2
        assert hits == len(weights) and abs(x - want) < 1e-9
    for text in ("𝐢𝐝𝐢𝐨𝐭", "i d i o t", "i.d.i.o.t", "ｉｄｉｏｔ", "Ⓘⓓⓘⓞⓣ", "IDIOT"):
        assert toxicity.fold(f"an {text} here") == " an idiot here "


def test_context_vectors_recomputed(spark):
    """A bucket's context vector and a document's row, word by word in plain loops."""
    texts = ["one two three two", "Two THREE four, one one", None, ""]
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    sums = np.zeros((quality.BUCKETS, quality.DIM))
    places = []
    for text in texts:
        data = (text or "").encode() + b" "
        bucket, _, shouted, again = quality.tokens(np.frombuffer(data, np.uint8), np.array([0]))
        places.append((bucket, shouted, again))
        for i in range(len(bucket)):
            for j in range(max(0, i - quality.WINDOW), min(len(bucket), i + quality.WINDOW + 1)):
                if i != j:
                    for to in [bucket[i], *([quality.SHOUTED] if shouted[i] else []), *([quality.REPEATED] if again[i] else [])]:
                        for place, sign in zip(quality._PLACE[bucket[j]], quality._SIGN[bucket[j]], strict=True):
                            sums[to, place] += sign
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got, unit, atol=1e-6)
    rows = quality.pooled(texts, got)
    for row, (bucket, shouted, again) in zip(rows, places, strict=True):
        values = []
        for b, s, a in zip(bucket, shouted, again, strict=True):
            v = got[b]
            v = (v + got[quality.SHOUTED]) / 2 if s else v
            values.append((v + got[quality.REPEATED]) / 2 if a else v)
        want = np.concatenate([np.mean(values, 0), np.std(values, 0), [shouted.mean(), again.mean()]]) if values else np.zeros(2 * quality.DIM + 2)
        assert np.allclose(row, want, atol=1e-5)


def test_neighbours_of_repeated_rows(spark):
    """A query id on two rows is asked once; candidates on two rows count twice; ties, few candidates, unusable vectors, other columns, an empty table."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [1.0, 0.1]), (2, [1.0, 0.2]), (7, [0.0, 1.0]), (9, None), (8, [0.0, 0.0]), (6, [float("nan"), 1.0]), (5, [None, 1.0])]
    v = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, part string, rank int")
    got = lambda df: [(r.query_id, r["rank"], r.vec_id) for r in neighbours.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got(v) == [(0, 1, 3), (0, 2, 2), (0, 3, 7)]
    assert got(v.unionByName(v.where("vec_id = 2"))) == [(0, 1, 3), (0, 2, 2), (0, 3, 2), (0, 4, 7)]
    assert got(v.limit(0)) == [] and got(spark.createDataFrame([(50, [1.0], 1), (2, [3.0], 1), (1, [2.0], 1)], "vec_id long, embedding array<double>, v int")) == [(50, 1, 1), (50, 2, 2)]


def test_recall_on_the_given_table(spark):
    """Partitions and router work on a table of any size; recall of the query on 0.01 against brute force."""
    from convan.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.stack(rows.embedding.map(lambda v: np.array(v, np.float64)).tolist())
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, found, hits = rows.vec_id.to_numpy(), {}, 0
    assert neighbours.parts_for(len(rows)) == 8
    for r in queries.op8_neighbours(spark, "/root/testdata/sf0.01").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q, near in found.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -2
        hits += len(near & set(ids[np.argsort(-s)[:5]].tolist()))
    assert set(found) == set(ids[ids % 50 == 0].tolist()) and hits >= 0.9 * 5 * len(found)
