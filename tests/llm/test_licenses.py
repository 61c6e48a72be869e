import textwrap
import time

import pytest

from foliant.llm import licenses as L


@pytest.mark.parametrize("name, text", sorted({(n, t) for n, t, _ in L.TEMPLATES}))
def test_each_template_is_found_in_running_text(name, text):
    found = L.find_licenses(f"first line\n{text}\nlast line")
    assert [(f[0], f[1], f[2]) for f in found] == [(name, 11, 11 + len(text))]


def test_relatives_are_told_apart():
    name = lambda t: [f[0] for f in L.find_licenses(t)]
    assert name("Licensed under CC BY 4.0.") == ["CC-BY-4.0"]
    assert name("licensed under cc by-nc 4.0") == ["CC-BY-NC-4.0"]
    assert name("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert name("Released under the MIT Licence") in ([], ["MIT"])
    assert name("Licensed under the terms of nobody.") == []
    assert name("a driving license is needed to drive") == []


def test_a_notice_over_lines():
    text = next(t for n, t, _ in L.TEMPLATES if n == "MIT" and t.startswith("Permission")).replace(", ", ",\n")
    assert [f[0] for f in L.find_licenses("x\n\n" + text)] == ["MIT"]


def test_edges(spark):
    notice = "All rights reserved."
    df = spark.createDataFrame([(1, notice), (1, notice), (None, notice), (2, None), (3, ""), (4, "é " * 50_000 + "\n" + notice)], "doc_id long, text string")
    got = sorted((str(r.doc_id), [(f.license, f.start) for f in r.findings]) for r in L.scan_licenses(df.withColumn("findings", df.text)).collect())
    one = [("Proprietary", 0)]
    assert got == [("1", one), ("1", one), ("2", []), ("3", []), ("4", [("Proprietary", 100_001)]), ("None", one)]
    assert L.scan_licenses(df.limit(0)).count() == 0


def test_against_the_lines_of_the_table(spark, sf_dir):
    """In the given table every license line is one of four known ones, or none."""
    known = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "Proprietary"}
    path = sf_dir.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r.licenses for r in L.op9_license_scan(spark, path).collect()}
    for r in spark.read.parquet(f"{path}/documents.parquet").collect():
        want = [known[x.strip()] for x in r.text.split("\n") if x.strip() in known]
        assert got[r.doc_id] == ",".join(want), r.doc_id


@pytest.mark.parametrize("width", [1, 12, 24, 40, 72, 10_000])
@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_any_wrapping_gives_the_whole_span(width, mark):
    for name, text, _ in L.TEMPLATES:
        lines = textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False)
        page = "Some prose here and then\n" + "\n".join(mark + x for x in lines) + "\n\nother words follow it"
        (got,) = L.find_licenses(page)
        start = page.index(mark + lines[0]) + len(mark)
        assert (got[0], got[1], got[2], got[4]) == (name, start, page.index(lines[-1] + "\n\nother") + len(lines[-1]), "")


def test_a_license_in_paragraphs_with_its_own_names():
    text = max((t for n, t, _ in L.TEMPLATES if n == "BSD-3-Clause"), key=len).replace("the copyright holder nor", "the University of Nowhere nor")
    page = "Copyright (c) 2001, Someone\n\n" + text.replace(" 1. ", "\n\n   1. ").replace(" 2. ", "\n\n   2. ").replace(" 3. ", "\n\n   3. ").replace(" THIS SOFTWARE", "\n\nTHIS SOFTWARE")
    (got,) = L.find_licenses(page)
    assert got[0] == "BSD-3-Clause" and page[got[1] : got[2]].startswith("Redistribution") and page[got[1] : got[2]].endswith("DAMAGE.")
    assert set(got[4].split()) == {"copyright", "holder"}


def test_several_licenses_of_one_block():
    page = "Licensed under the MIT License. or, at your choice, Licensed under the Apache License, Version 2.0. as the case may be"
    got = L.find_licenses(page)
    assert [(g[0], page[g[1] : g[2]]) for g in got] == [("MIT", "Licensed under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0.")]


def test_each_license_is_told_from_its_relatives():
    whole = {}
    for name, text, _ in L.TEMPLATES:
        whole[name] = max(whole.get(name, ""), text, key=len)
    page = "\n\n".join(whole.values())
    assert [g[0] for g in L.find_licenses(page)] == list(whole)


def test_work_grows_with_the_length_alone():
    began = time.perf_counter()
    assert len(L.find_licenses("Licensed under the MIT License.\n" * 50_000)) == 50_000
    assert L.find_licenses("the license of this file is not known\n" * 50_000) == []
    assert L.find_licenses("license" * 500_000) == []
    assert time.perf_counter() - began < 60


def plain_notices(text):
    """Exact wording, template by template, the longest first: no compression and no windows."""
    words = L.words_of(text or "")
    taken, found = [False] * len(words), []
    for name, template, _ in sorted(L.TEMPLATES, key=lambda t: -len(L.words_of(t[1]))):
        want = L.words_of(template)
        i = 0
        while i + len(want) <= len(words):
            if words[i : i + len(want)] == want and not any(taken[i : i + len(want)]):
                taken[i : i + len(want)] = [True] * len(want)
                found.append((i, name))
                i += len(want)
            else:
                i += 1
    return [n for _, n in sorted(found)]


def test_against_exact_wording_on_whole_tables(spark, sf_dir):
    """Every notice that stands word for word in a whole text is found, and nothing else in the given tables."""
    path = sf_dir.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r.licenses for r in L.op9_license_scan(spark, path).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    assert got == {d: ",".join(plain_notices(t)) for d, t in texts.items()} and any(got.values())
