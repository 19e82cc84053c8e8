import re
from collections import defaultdict

import pytest

from pricelens.llm import licenses as L, substring_dedup as S
from . import data

LINES = [
    (100, "A shared line of seven words here\nshort\nunique words only in this one", None),
    (101, "a  SHARED line of seven\twords here \nshort\nA shared line of seven words here\n", None),
    (99, "intro line that nobody else has got\n\nA shared line of seven words here", None),
    (None, "A shared line of seven words here", None),
    (102, "é🙂 before the line é🙂\nA shared line of seven words here\ntail", None),
    (102, "é🙂 before the line é🙂\nA shared line of seven words here\ntail", None),
]


def rows():
    return data.documents() + [(d, t, *[None] * 7) for d, t, _ in LINES]


def brute(rs, min_words=5):
    seen = defaultdict(list)
    for d, t, *_ in rs:
        for m in re.finditer(r"[^\n]+", t or ""):
            w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in m[0])) if x]
            if len(w) >= min_words:
                seen[" ".join(w)].append((d is None, d or 0, m.start(), m.end(), len(w)))
    out = []
    for occ in seen.values():
        occ.sort()
        out += [(None if n else d, s, e, k, occ[0][1] if not occ[0][0] else None, occ[0][2], len(occ)) for n, d, s, e, k in occ[1:]]
    return sorted(out, key=repr)


def test_removals(spark):
    got = S.removals(spark, data.frame(spark, rows()))
    assert got.columns == ["doc_id", "start", "end", "n_words", "keep_doc_id", "keep_start", "copies"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows())
    assert S.removals(spark, data.empty(spark)).count() == 0
    long = S.removals(spark, data.frame(spark, rows()), "paragraph", 3).collect()
    assert all(r.copies > 1 for r in long)


MARKS = {"line": "\n", "sentence": "\n.!?", "clause": "\n.!?,;:"}


def brute_runs(rs, unit, min_words, min_run_words, across):
    """Units cut at the marks by hand, runs walked one by one."""
    def cut(text):
        at, out = 0, []
        while at < len(text):
            e = at
            while e < len(text) and text[e] not in MARKS[unit]:
                e += 1
            stop = e
            while unit != "line" and stop < len(text) and text[stop] in MARKS[unit]:
                stop += 1
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text[at:e])
            w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
            if w:
                out.append((at, stop, w))
            at = max(stop, at + 1)
        return out
    rows = [(i, r[0], cut(r[1] or "")) for i, r in enumerate(rs)]
    seen = defaultdict(list)
    for i, d, us in rows:
        for s, e, w in us:
            if len(w) >= min_words:
                seen[" ".join(w)].append((d is None, d or 0, s, i))
    out = []
    for i, d, us in rows:
        run = []
        for u in [*us, None]:
            occ = seen[" ".join(u[2])] if u and len(u[2]) >= min_words else []
            if len({o[3] for o in occ}) > 1 if across else len(occ) > 1:
                run.append((u, occ))
                continue
            words = sum(len(x[2]) for x, _ in run)
            if words >= min_run_words:
                for (s, e, w), o in run:
                    first = min(x[:3] for x in o)
                    out.append((d, s, e, len(w), words, None if first[0] else first[1], first[2], len(o)))
            run = []
    return sorted(out, key=repr)


PASSAGE = "this passage of words, Stands in several texts; it has marks! and lines\r\nof its own: so that it is cut. into clauses,, all of them repeated"


def passages():
    rows = [(300, "before it. " + PASSAGE + ". after it"), (301, PASSAGE.upper()), (302, "x " + PASSAGE + " y"), (None, PASSAGE), (303, PASSAGE + "\n" + PASSAGE),
            (304, "and lines\nof its own, it has marks"), (305, "..., ;" + PASSAGE.replace(" ", "\t ")), (306, "all of them repeated"), (307, "solo solo. solo solo. solo solo. solo solo")]
    return data.documents() + LINES_AS_ROWS + [(d, t, *[None] * 7) for d, t in rows]


LINES_AS_ROWS = [(d, t, *[None] * 7) for d, t, _ in LINES] + [(308, "crlf line of more than five words\r\nend", *[None] * 7), (309, "crlf line of more than  five words\r\nother", *[None] * 7)]


@pytest.mark.parametrize("unit, min_words, run, across", [("clause", 1, 12, True), ("clause", 1, 30, True), ("sentence", 2, 8, False), ("line", 5, 0, False), ("line", 1, 9, True)])
def test_runs(spark, unit, min_words, run, across):
    got = S.repeats(spark, data.frame(spark, passages()), unit, min_words, run, across)
    assert got.columns == ["doc_id", "start", "end", "n_words", "run_words", "keep_doc_id", "keep_start", "copies", "kept"]
    rows = got.collect()
    want = brute_runs(passages(), unit, min_words, run, across)
    assert want and sorted((tuple(r)[:-1] for r in rows), key=repr) == want
    kept = [(r.keep_doc_id, r.keep_start, r.n_words, r.copies) for r in rows if r.kept]
    assert len(kept) == len({(r.doc_id, r.start, r.end) for r in rows if r.kept}) or any(k[0] in (None, 1, 102) for k in kept)
    assert S.repeats(spark, data.empty(spark), unit, min_words, run, across).count() == 0


def test_cut_passages(spark):
    rows = [(1, "head. " + PASSAGE + ". tail one"), (2, "other head. " + PASSAGE + ". tail two"), (3, "all of them repeated")]
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "doc_id bigint, text string, row string, key string, of string").repartition(2)
    out = S.cut_copies(spark, docs, "clause", 1, 20, True)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "other head. tail two", 3: rows[2][1]}
    cut = S.without(docs, S.removals(spark, docs, "clause", 1, 20, True))
    assert {tuple(r) for r in cut.collect()} == {tuple(r) for r in out.collect()}


def test_cut_texts(spark):
    rs = [r for r in rows() if r[0] not in (None, 1, 102)]
    docs = data.frame(spark, rs)
    out = S.without(docs, S.removals(spark, docs))
    assert out.columns == docs.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[99] == LINES[2][1]
    assert text[100] == "short\nunique words only in this one" and text[101] == "short\n"
    assert text[3] is None and text[4] == "" and len(text) == len(rs)


def test_cut_copies_by_row(spark):
    line, own = "A shared line of seven words here", "another text of its own, long enough to be cut wrongly"
    rows = [(1, line), (None, line + "\nx"), (None, own), (7, own + " too"), (7, line + "\ny"), (8, line), (8, line)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = S.cut_copies(spark, docs)
    assert out.columns == docs.columns
    want = [(1, line), (None, "x"), (None, own), (7, own + " too"), (7, "y"), (8, ""), (8, "")]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert S.cut_copies(spark, data.frame(spark, [])).count() == 0


def test_licenses(spark):
    mit = dict((i, t) for i, t in L.KNOWN if t.startswith("Permission is hereby"))["MIT"]
    wrapped = "The MIT Licence (MIT)\r\n\r\nCopyright (c) 2020, 2021 Some Body\r\nAll rights reserved.\r\n\r\n" + mit.replace(". ", ".\r\n").replace("sublicense", "sublicence").lower()
    rs = data.documents() + [(d, t, *[None] * 7) for d, t in (
        (200, wrapped), (201, "prose\nRELEASED   under the MIT licence!\nmore"), (202, "Licensed under CC BY-NC 4.0."),
        (203, wrapped + " and one more word"), (204, "  * SPDX-License-Identifier: MIT */"), (205, "all rights reserved"), (None, "Licensed under CC BY 4.0"))]
    got = sorted(map(tuple, L.find_licenses(spark, data.frame(spark, rs)).collect()), key=repr)
    assert got == sorted([(200, "MIT", "text", None), (200, "all-rights-reserved", "line", 3), (201, "MIT", "line", 1),
                          (202, "CC-BY-NC-4.0", "text", None), (202, "CC-BY-NC-4.0", "line", 0), (203, "all-rights-reserved", "line", 3),
                          (204, "MIT", "text", None), (204, "MIT", "line", 0), (205, "all-rights-reserved", "line", 0),
                          (None, "CC-BY-4.0", "text", None), (None, "CC-BY-4.0", "line", 0)], key=repr)
    assert L.find_licenses(spark, data.empty(spark)).count() == 0


def test_copyright_lines_of_all_forms(spark):
    mit = "Permission is hereby" + next(t for i, t in L.KNOWN if i == "MIT").split("Permission is hereby")[1]
    notices = ["Copyright (c) Microsoft Corporation. All rights reserved.", "Copyright (c) Facebook, Inc. and its affiliates.", "Copyright Jane Doe 2020",
               "(c) Jane 2020", "© 2020 Jane", "© Jane Doe", "Portions Copyright (c) 2020 X", "Copyright (c) [year] [fullname]", "Copyright (c) <year> <copyright holders>",
               " * Copyright [yyyy] [name of copyright owner]", "# Copyright: Jane Doe", "copyright jane doe, 2020", "Copyright 2020 Jane", "(C) Jane Doe and Others", "&copy; no"]
    body = ["copyright notice and this", "COPYRIGHT HOLDER BE LIABLE", "COPYRIGHT OWNER OR CONTRIBUTORS", "copyright license to reproduce", "Copyright and Related Rights",
            "copyright on the Program, and", "(c) You must retain, in the Source", "copyrighted 2020", "Copyright Act of 1976", "scope (c) 2020",
            "(c) " + "A" * 50_000 + "!", "(c) " + "A." * 50_000 + "!", "copyright" + " " * 50_000 + "x", "(" * 50_000]  # no backtracking over long lines
    rs = [(i, f"MIT License\n\n{x}\n\n{mit}", *[None] * 7) for i, x in enumerate(notices + body)]
    got = {r.doc_id for r in L.find_licenses(spark, data.frame(spark, rs)).where("scope = 'text'").collect()}
    assert [x for i, x in enumerate(notices + body) if i in got] == notices[:-1] + body[-1:]  # a line of punctuation alone is empty


def test_full_texts(spark):
    ids = {"Apache-2.0", "Artistic-1.0-Perl", "BSD-3-Clause", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0",
           "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense"}
    texts = [(i, t) for i, t in L.full_texts() if "\n" in t]
    assert {i for i, _ in texts} == ids
    bsd3 = next(t for i, t in L.KNOWN if i == "BSD-3-Clause")
    gpl2 = next(t for i, t in texts if i == "GPL-2.0" and "51 Franklin Street" in t)
    assert "51 Franklin" in gpl2
    more = [("BSD-3-Clause", re.sub(r"\b[123]\. ", "\n * ", bsd3)), ("BSD-3-Clause", re.sub(r"\b[123]\. ", "\n", "BSD 3-Clause License\n(c) 2020 Jane\n" + bsd3)),
            ("GPL-2.0", re.sub(r"51 Franklin Street.*USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA", gpl2).replace("\n", "\r\n")),
            ("LGPL-2.0", re.sub(r"51 Franklin Street.*USA", "675 Mass Ave, Cambridge, MA 02139, USA", next(t for i, t in texts if i == "LGPL-2.0" and "51 Franklin Street" in t))),
            (None, gpl2 + "and more")]
    rs = [(i, t, *[None] * 7) for i, (_, t) in enumerate(texts + more)]
    got = sorted((r.doc_id, r.license_id) for r in L.find_licenses(spark, data.frame(spark, rs)).where("scope = 'text'").collect())
    assert got == [(i, want) for i, (want, _) in enumerate(texts + more) if want]


def test_license_plan_is_native(spark):
    plan = L.find_licenses(spark, data.frame(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
