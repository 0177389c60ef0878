"""Parent and child sections: outputs derived by hand."""

import pytest

from quireflow.operators.chunking import children, chunked
from quireflow.options import ChunkingOptions


def run(spark, text, **options):
    return chunked(spark.createDataFrame([("d", text)], "doc_id string, markdown string"), ChunkingOptions(**options)).first().chunked


def kids(spark, text, **options):
    rows = children(spark.createDataFrame([("d", text)], "doc_id string, markdown string"), ChunkingOptions(**options))
    return [tuple(r)[3:] for r in rows.orderBy("parent_idx", "child_idx").collect()]


GARDEN = "--- Page 4 ---\n\n# Orchard Notes\n\n## Grafting\n\nCut the scion in late winter, before the buds swell.\n\n--- Page 5 ---\n\nBind it with raffia and wax.\n\n## Pruning\n\nRemove crossing branches first."


def test_parents_across_pages(spark):
    assert run(spark, GARDEN, child_target_chars=200, child_overlap_chars=50) == (
        "<<<PARENT_BREAK>>>\n\n<<<CHILD_BREAK>>>\n\nSection: Orchard Notes > Grafting\n\nSource: Page 4-5\n\nContent:\n\n--- Page 4 ---\n\n# Orchard Notes\n\n## Grafting\n\n"
        "Cut the scion in late winter, before the buds swell.\n\n--- Page 5 ---\n\nBind it with raffia and wax.\n\n<<<PARENT_BREAK>>>\n\n<<<CHILD_BREAK>>>\n\n"
        "Section: Orchard Notes > Pruning\n\nSource: Page 5\n\nContent:\n\n--- Page 5 ---\n\n## Pruning\n\nRemove crossing branches first."
    )


def test_overlap(spark):
    first, second, third = "Bees leave the hive once the air is warm enough to fly.", "They return heavy, and rest on the board.", "In rain the guards stay at the entrance all day long."
    rows = kids(spark, "\n\n".join(["--- Page 9 ---", "# Hives", "## Flight", first, second, third]), child_target_chars=100, child_overlap_chars=75)
    assert [r[:3] for r in rows] == [
        ("Hives > Flight", "Page 9", ""), ("Hives > Flight", "Page 9", f"Hives Flight {first}"), ("Hives > Flight", "Page 9", second),
    ]
    assert [r[3] for r in rows[1:]] == [f"--- Page 9 ---\n\n{second}", f"--- Page 9 ---\n\n{third}"]


def test_table_is_not_split(spark):
    table = "| Tree | Years |\n| --- | --- |\n| Quince | 5 |\n| Walnut in the valley | 12 |"
    rows = kids(spark, f"--- Page 2 ---\n\n# Yield\n\n## First fruit\n\nCounted from planting.\n\n{table}\n\nMedlars vary.", child_target_chars=70, child_overlap_chars=20)
    assert [r[2] for r in rows] == ["", "...unted from planting.", "...in the valley | 12 |"]
    assert rows[1][3] == f"--- Page 2 ---\n\n{table}"
    assert {r[:2] for r in rows} == {("Yield > First fruit", "Page 2")}


def test_long_documents_take_linear_time():
    import time

    from quireflow.operators.chunking import parents_of

    def took(n):
        text = "\n\n".join(x for i in range(n) for x in (f"--- Page {i + 1} ---", f"## Part {i}", f"line {i} of a long text " * 3, "more"))
        began = time.perf_counter()
        assert len(parents_of(text, ChunkingOptions())) == n
        return time.perf_counter() - began

    took(500)
    assert took(16_000) < 8 * took(4_000) + 0.5


def test_size_split_keeps_the_first_title(spark):
    rows = kids(spark, f"# A\n\n## B\n\n{'a' * 20}\n\n{'b' * 20}", parent_max_chars=40)
    assert [r[:2] for r in rows] == [("A > B", "Unknown page"), ("A", "Unknown page")]


@pytest.mark.parametrize(
    "text", ["# A\n\n## B", "## Кириллица", "a\n\n<<<CHILD_BREAK>>>\n\nb", ""]
)
def test_nothing_to_chunk(spark, text):
    assert run(spark, text) == text


def test_trailing_heading_is_lost(spark):
    rows = kids(spark, "# A\n\ntext\n\n## Tail")
    assert [(r[0], r[3]) for r in rows] == [("A", "# A\n\ntext")]


def test_heading_with_text_is_a_block(spark):
    assert kids(spark, "# T\nbody") == [("Document section", "Unknown page", "", "# T\nbody")]


def test_page_ranges(spark):
    text = "\n\n".join(f"--- Page {n} ---\n\ntext {n}" for n in (1, 2, 4))
    assert kids(spark, text)[0][1] == "Page 1-2, 4"


def test_unicode_white_space_and_rechunking(spark):
    once = run(spark, "# A \n　\nbody text\r\n\r\nmore")
    assert "# A\n\nbody text\n\nmore" in once
    assert run(spark, once) == once


def test_null_and_empty_table(spark):
    assert run(spark, None) == ""
    assert children(spark.createDataFrame([], "doc_id string, markdown string")).count() == 0
