from pyspark.sql import functions as F

from trajkit.llm import licenses

MIT = licenses.TEMPLATES["MIT"]
LONG = licenses.TEMPLATES["MIT-notice"]


def test_each_template_is_its_own_best():
    for name, text in licenses.TEMPLATES.items():
        found = licenses.best_template(f"See: {text.upper()} Thanks", licenses.TEMPLATES, 0.8)
        assert (found[0], found[5]) == (name, True), (name, found)


def test_differences_are_the_exact_words():
    found = licenses.best_template("Released under that old MIT License.", licenses.TEMPLATES, 0.4)
    assert found[0] == "MIT" and sorted(found[4].split()) == ["+old", "+that", "-the"]
    assert licenses.best_template("The driving license was lost, under the rain", licenses.TEMPLATES, 0.8) is None or not licenses.best_template("The driving license was lost, under the rain", licenses.TEMPLATES, 0.8)[5]


def test_planted_notices_are_found_in_place(spark):
    texts = {1: f"intro words\n{MIT}\nmore", 2: "x " * 40_000 + LONG + " y" * 40_000, 3: None, 4: "", 5: "no such thing", 6: f"{MIT}\n{MIT}", 7: licenses.TEMPLATES["GPL-3.0"].replace("version 3", "version  3")}
    docs = spark.createDataFrame([*texts.items(), (None, MIT), (8, MIT), (8, MIT)], "doc_id long, text string").withColumns({"start": F.lit("clash"), "license": F.lit(1)})
    rows = licenses.scan_licenses(docs).where("confirmed").collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["license"], r["start"], r["end"]))
    assert {k: sorted(x[0] for x in v) for k, v in got.items()} == {1: ["MIT"], 2: ["MIT-notice"], 6: ["MIT", "MIT"], 7: ["GPL-3.0"], None: ["MIT"], 8: ["MIT", "MIT"]}
    _, start, end = got[2][0]
    assert texts[2][start:end] == LONG
    _, start, end = got[1][0]
    assert texts[1][start:end] == MIT[:-1]
    assert licenses.scan_licenses(docs.where("false")).count() == 0


def test_every_notice_of_the_tables_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs).where("confirmed").collect()}
    for r in docs.collect():
        for name in ("MIT", "GPL-3.0", "Apache-2.0", "CC-BY-NC-4.0"):
            if licenses.TEMPLATES[name] in r["text"]:
                assert (r["doc_id"], name) in found


def test_all_rights_reserved_is_found_without_copyright(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"] for r in licenses.scan_licenses(docs).where("confirmed and license = 'rights-reserved'").collect()}
    planted = {r["doc_id"] for r in docs.collect() if "All rights reserved." in r["text"].split("\n")}
    assert planted and planted <= found
    assert licenses.best_template("Copyright. All rights reserved.", licenses.TEMPLATES, 0.8)[0] == "all-rights-reserved"


def confirmed(spark, text, **more):
    rows = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"), **more).where("confirmed").orderBy("start").collect()
    return [(r["license"], text[r["start"] : r["end"]]) for r in rows]


def test_every_notice_of_a_line_is_found(spark):
    mit, cc = MIT[:-1], licenses.TEMPLATES["CC-BY-NC-4.0"][:-1]
    assert confirmed(spark, f"{MIT} {cc}.") == [("MIT", mit), ("CC-BY-NC-4.0", cc)]
    assert confirmed(spark, f"{MIT} {MIT} or {MIT}") == [("MIT", mit)] * 3
    # The best alignment counts, not that of the first long run of words.
    assert confirmed(spark, f"Released under the sun; see the license. {MIT.replace('MIT', 'old MIT')}") == [("MIT", "Released under the old MIT License")]
    every = [(name, text) for name, text in sorted(licenses.TEMPLATES.items())]
    assert [name for name, _ in confirmed(spark, " ".join(text for _, text in every))] == [name for name, _ in every]


def test_alignment_is_the_best_of_all(spark):
    import random
    from itertools import combinations

    draw = random.Random(3)
    for _ in range(150):
        own = [draw.choice("abc") for _ in range(draw.randint(1, 5))]
        said = [draw.choice("abcx") for _ in range(draw.randint(1, 7))]
        prepared = licenses._prepared((("t", " ".join(own)), ("longer", "a b c a b c a")), 0.5)
        k = prepared.names.index("t")
        best = len(own)
        for size in range(1, min(len(own), len(said)) + 1):
            for left in combinations(range(len(own)), size):
                for right in combinations(range(len(said)), size):
                    if [own[i] for i in left] == [said[j] for j in right]:
                        best = min(best, len(own) - size + right[-1] - right[0] + 1 - size)
        costs = prepared.costs(said)[:, k]
        assert costs.min() // prepared.put_in == best
        pairs = prepared.aligned(k, said[: int(costs.argmin()) + 1])
        if pairs:
            assert sum(map(len, prepared.differences(k, pairs, said))) == best


def test_wrapped_notices_are_found(spark):
    import textwrap

    templates = licenses.TEMPLATES
    for width in (24, 40, 80):
        for mark in ("", " * ", "# ", "// "):
            texts = [(i, "import x\n" * 60 + "/*\n" + textwrap.fill(text, width, initial_indent=mark, subsequent_indent=mark, break_long_words=False) + "\n*/\n" + "more words\n" * 60) for i, (_, text) in enumerate(templates.items())]
            rows = licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).where("confirmed").collect()
            assert sorted((r["doc_id"], r["license"], r["differences"]) for r in rows) == [(i, name, "") for i, name in enumerate(templates)]
            for r in rows:
                assert [w for w, _, _ in licenses._words(texts[r["doc_id"]][1][r["start"] : r["end"]])] == [w for w, _, _ in licenses._words(templates[r["license"]])]
    header = "/* " + " ".join(templates[n] for n in ("all-rights-reserved", "BSD-3-Clause", "MIT-notice", "GPL-3.0-notice")) + " */"
    assert [n for n, _ in confirmed(spark, textwrap.fill(header, 60, subsequent_indent=" * "))] == ["all-rights-reserved", "BSD-3-Clause", "MIT-notice", "GPL-3.0-notice"]
    extra = LONG.replace("free of charge", "free of any charge or fee at all").split()
    assert [n for n, _ in confirmed(spark, "\n".join(extra))] == ["MIT-notice"]


def test_blocks_hold_every_word_near_a_cue_once():
    import random

    draw = random.Random(5)
    for _ in range(300):
        said = [draw.choice(["license", *"abcdefghijklmnopqrstuvw"]) for _ in range(draw.randint(0, 60))]
        reach = draw.randint(1, 6)
        text = "\n".join(said)
        near = [i for i in range(len(said)) if "license" in said[max(0, i - reach) : i + reach + 1]]
        blocks = list(licenses.candidate_blocks(text, reach))
        words = licenses._words(text)
        assert [w for block, _ in blocks for w in block] == [words[i] for i in near]
        assert all([block[p][0] for p in places] == ["license"] * len(places) and places == [i for i, w in enumerate(block) if w[0] == "license"] for block, places in blocks)


def test_identifiers_are_found(spark):
    text = "#!/bin/sh\n# SPDX-License-Identifier: MIT\nx = 1\n// SPDX-License-Identifier: GPL-3.0-or-later\n" + "words " * 40 + "* SPDX-License-Identifier: Apache-2.0"
    assert [n for n, _ in confirmed(spark, text)] == ["SPDX:MIT", "SPDX:GPL-3.0-or-later", "SPDX:Apache-2.0"]


def test_query_equals_brute_force(spark):
    from trajkit.llm import queries

    # Every place of every text where a whole template stands word by word, unless a longer one holds it.
    sf = "/root/testdata/sf0.001"
    templates = {n: [w for w, _, _ in licenses._words(t)] for n, t in licenses.TEMPLATES.items()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = set()
    for i, text in texts.items():
        words = licenses._words(text or "")
        said = [w for w, _, _ in words]
        places = [(a, a + len(t), n) for n, t in templates.items() for a in range(len(said) - len(t) + 1) if said[a : a + len(t)] == t]
        want |= {(i, words[a][1], words[b - 1][2], n) for a, b, n in places if not any((c <= a and b <= d) and (c, d) != (a, b) for c, d, _ in places)}
    rows = queries.op6_license_scan(spark, sf).collect()
    got = {(r["doc_id"], r["start"], r["end"], r["license"]) for r in rows if r["confirmed"] and not r["differences"]}
    assert want and got == want
    for r in rows:
        if r["confirmed"]:
            changed = r["differences"].split()
            own, said = list(templates[r["license"]]), [w for w, _, _ in licenses._words(texts[r["doc_id"]][r["start"] : r["end"]])]
            assert (len(own) - len(changed)) / len(own) >= 0.8
            assert sorted(own + [c[1:] for c in changed if c[0] == "+"]) == sorted(said + [c[1:] for c in changed if c[0] == "-"])
