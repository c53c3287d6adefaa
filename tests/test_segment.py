"""Segmentation against hand-made cases and an independent stack walk."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafscan.functions import text as X
from leafscan.operators import index as I
from leafscan.operators import segment as S

NUM = "一二三四五六七八九十百千万零〇"


def split(spark, text, mode):
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string").withColumn("text", X.normalize_text("text"))
    rows = S.outline(docs, mode)
    toc = [(r["level"], r["title"], r["heading_path"]) for r in S.toc_of(rows).orderBy("toc_no").collect()]
    blocks = [(r["kind"], r["text"], r["heading_path"], r["char_start"], r["char_end"]) for r in S.blocks_of(rows).orderBy("first_pos").collect()]
    return toc, blocks


def test_heading_stack(spark):
    toc, blocks = split(spark, "# A\nx\n### B\ny\n## C\nz\n# D", "heading")
    assert [t[2] for t in toc] == [["A"], ["A", "B"], ["A", "C"], ["D"]]
    assert [(b[1], b[2]) for b in blocks] == [("x", ["A"]), ("y", ["A", "B"]), ("z", ["A", "C"])]


def test_numbered_levels_follow_colons(spark):
    toc, _ = split(spark, "# H\n1、总则：\n（1）甲\n（2）乙", "heading_plus_numbered")
    assert [t[0] for t in toc] == [1, 2, 3, 2]
    assert toc[2][2] == ["H", "1、总则：", "（1）甲"] and toc[3][2] == ["H", "（2）乙"]


def test_legal_text_without_bodies(spark):
    toc, blocks = split(spark, "第一章 总则\n第一节 范围\n第一条 正文", "legal")
    assert [t[0] for t in toc] == [1, 2, 3] and blocks == []


def test_blocks_by_kind(spark):
    _, blocks = split(spark, "# H\ntext\n|a|b|\n|-|-|", "block")
    assert [b[0] for b in blocks] == ["text", "table"]


def walk(text, legal):
    """Reference walk with explicit stacks: toc and the text under every path."""
    heads, marks, toc, out = [], [], [], []
    cur, path = [], []

    def close():
        body = "\n".join(cur).strip()
        if body:
            out.append((body, path))
        cur.clear()

    for line in text.split("\n"):
        level, title = None, line.strip()
        if legal:
            for depth, unit in enumerate("章节条", 1):
                if re.match(rf"\s*第[一二三四五六七八九十百千0-9]+{unit}", line):
                    level = depth
                    break
        else:
            m = re.match(r"(#{1,6})\s+(\S.*)", line)
            if m:
                level, title = len(m[1]), m[2].strip()
        mark = re.match(rf"\s*(\d+(?:\.\d+)+(?=\s)|\d+[.、．]|[{NUM}]+[、．.]|[（(][{NUM}]+[）)]|[（(]\d+[）)]|\d+[）)])\s*\S", line)
        if level:
            close()
            heads = [h for h in heads if h[0] < level] + [(level, title)]
            marks = []
            path = [h[1] for h in heads]
            toc.append((level, title, path))
        elif mark and heads:
            close()
            sign = mark[1]
            if re.match(r"\d+\.\d", sign):
                n = sign.count(".") + 1
            elif re.match(r"[（(]?\d+[）)]", sign) and marks and marks[-1][1][-1] in "：:":
                n = marks[-1][0] + 1
            else:
                n = 1
            marks = [m for m in marks if m[0] < n] + [(n, title)]
            path = [h[1] for h in heads] + [m[1] for m in marks]
            toc.append((heads[-1][0] + n, title, path))
            cur.append(line)
        else:
            cur.append(line)
    close()
    return toc, out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("mode", ["heading_plus_numbered", "legal"])
def test_outline_against_walk(spark, seed, mode):
    rng = random.Random(seed)
    heads = ["第三章 总则", "第二节 范围", "第五条 内容"] if mode == "legal" else ["# A", "## B", "### C"]
    marks = ["1、项：", "（1）子", "(2) 子：", "1.2 段", "1.2.3 段", "二、款", "（三）目", "3) 条："]
    lines = [rng.choice(heads + marks + ["正文一", "正文二", ""]) for _ in range(60)]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    toc, blocks = split(spark, text, mode)
    want_toc, want_blocks = walk(text, mode == "legal")
    assert toc == want_toc
    assert [(b[1], b[2]) for b in blocks] == want_blocks
    assert all(0 <= b[3] <= b[4] <= len(text) for b in blocks)


def greedy(text, limit, lap):
    if len(text) <= limit:
        return [text]
    parts, cur = [], ""
    for p in (x.strip() for x in re.split(r"\n\s*\n", text)):
        if not p:
            continue
        if len(cur) + len(p) + 2 <= limit:
            cur = (cur + "\n\n" + p).strip()
            continue
        parts += [cur] if cur else []
        if len(p) <= limit:
            cur = p
        else:
            i = 0
            while True:
                parts.append(p[i : i + limit])
                if i + limit >= len(p):
                    break
                i += limit - lap
            cur = ""
    return parts + ([cur] if cur else [])


@pytest.mark.parametrize("seed", range(5))
def test_pack_against_greedy(spark, seed):
    rng = random.Random(seed)
    text = "\n\n".join("x" * rng.choice([3, 10, 20, 55, 130]) + str(i) for i in range(12))
    got = spark.createDataFrame([(text,)], "t string").select(S.pack("t", 40, 7).alias("p")).first()["p"]
    assert got == greedy(text, 40, 7)


def test_identity(spark):
    paths = [
        ("/x/raw_md/bonds/strict_v1_2_Title.md", "bonds", "strict_v1_2_Title", "Title"),
        ("/x/raw/law/a_no_images.md", "law", "a", "Heading"),
        ("/x/other/b.c.txt", "unknown", "b.c", "Heading"),
    ]
    for path, domain, doc_id, title in paths:
        row = spark.range(1).select(
            I.domain_of(F.lit(path), "/x/other").alias("d"), I.doc_id_of(F.lit(path)).alias("i"), I.title_of(F.lit(path), F.lit("Heading")).alias("t")
        ).first()
        assert (row["d"], row["i"], row["t"]) == (domain, doc_id, title)


def test_every_section_has_one_parent(spark):
    text = "# A\n## B\nx\n#### C\ny\n## B\nz\n# D\n### E\nw"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rows = S.outline(docs, "heading")
    toc = S.toc_of(rows)
    blocks = S.blocks_of(rows).select("*", F.lit("m").alias("domain"), F.lit("t").alias("title"), F.lit("p").alias("source_path"), F.lit("heading").alias("mode"))
    sections = {r["section_id"]: r for r in I.sections(toc, S.make_pages(blocks)).collect()}
    assert sections["d_sec_0003"]["parent_id"] == "d_sec_0002"
    assert sections["d_sec_0001"]["children_ids"] == ["d_sec_0002"]
    # the second B has the path of the first and is not a section of its own
    assert "d_sec_0004" not in sections
    assert sections["d_sec_0002"]["page_ids"] == ["d_lp_0001", "d_lp_0003"]
    assert sections["d_sec_0001"]["page_ids"] == [] and len(sections["d_sec_0001"]["descendant_page_ids"]) == 3
