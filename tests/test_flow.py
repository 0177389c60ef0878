"""Rendering, gates, chain, validation and sources: outputs derived by hand."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from quireflow.operators import gates, matrix, tables, tree
from quireflow.operators.fallback import AFTER_OCR, NO_ANSWER, NOT_SELECTED, convert
from quireflow.operators.gates import IMAGE_ONLY, VISUAL_PAGE
from quireflow.operators.validate import validated
from quireflow.options import ChunkingOptions, Options
from quireflow.plans import queries
from quireflow.plans.command import CommandExtractor
from quireflow.plans.convert import converted, rendered
from quireflow.sources.files import artifacts, responses, uploads

H = lambda text, level=1, **k: {"type": "heading", "heading level": level, "content": text} | k
P = lambda text, **k: {"type": "paragraph", "content": text} | k


def box(x0, y0, w=60, h=12):
    return {"bounding box": [x0, y0, x0 + w, y0 + h], "page number": 1}


def table(*rows):
    return {"type": "table", "rows": [{"cells": [{"column number": n, "kids": [P(c)]} for n, c in enumerate(r, 1)]} for r in rows]}


YEARS = [(100, 900, "1911", "- Lighthouse lit"), (300, 900, "1936", "- Breakwater built"), (100, 700, "1987", "- Ferry line closed"), (300, 700, "2009", "- Wind park joined")]
TIMELINE = [H("Harbour", **box(0, 1000))] + [x for x0, y, a, b in YEARS for x in (P(a, **box(x0, y)), P(b, **box(x0, y - 45)))]
FACTS = [("Berths", "41"), ("Cranes", "12"), ("Pilots", "27"), ("Depth", "14.5 m")]
METRICS = [P("Port in figures", **box(0, 1000)), P("As counted in spring.", **box(0, 960))] + [
    x for n, (a, b) in enumerate(FACTS) for x in (P(a, **box(150 * n, 700)), H(b, 2, **box(150 * n, 660), **{"font size": 18}))
]
CASES = {
    "mixed": ([H("Tide tables"), H("North pier", 2), P("Times are local."), table(["Hour", "Level"], ["06:10", "low | slack"]), {"type": "picture", "description": "A gauge."}],
              "# Tide tables\n\n## North pier\n\nTimes are local.\n\n| Hour | Level |\n| --- | --- |\n| 06:10 | low \\| slack |\n\n**Image summary:** A gauge."),
    "none": ([], "# Fallback"),
    "timeline": (TIMELINE, "--- Page 1 ---\n\n## Harbour\n\n- 1911: Lighthouse lit\n\n- 1936: Breakwater built\n\n- 1987: Ferry line closed\n\n- 2009: Wind park joined"),
    "metrics": (METRICS, "--- Page 1 ---\n\n## Port in figures\n\nAs counted in spring.\n\n| 항목 | 내용 |\n| --- | --- |\n| Berths | 41 |\n| Cranes | 12 |\n| Pilots | 27 |\n| Depth | 14.5 m |"),
    "image page": ([{"type": "image", "page number": 1}], f"--- Page 1 ---\n\n{IMAGE_ONLY}"),
    "thin page": ([H("Mooring rules", **{"page number": 1}), {"type": "image", "page number": 1}], f"--- Page 1 ---\n\n# Mooring rules\n\n{VISUAL_PAGE}"),
    "page-less dropped": ([P("kept", **{"page number": 2}), P("lost")], "--- Page 2 ---\n\nkept"),
    "header": ([{"type": "header", "content": "top"}, P("body"), {"type": "caption", "content": "c"}], "body\n\n*c*"),
    "numbered": ([{"type": "list", "numbering style": "unordered", "list items": [{"content": "a"}, {"content": ""}, {"content": "c"}]}], "1. a\n3. c"),
    "nested": ([{"type": "list", "list items": [{"content": "a", "kids": [{"type": "list", "items": [{"content": "b"}]}]}]}], "- a\n    - b"),
}


def test_rendering(spark):
    rows = [(k, json.dumps({"kids": v[0]}), "# Fallback") for k, v in CASES.items()] + [("broken", "{", "x"), ("no tree", None, "x \n"), ("deep", "[" * 200_000, "x"), ("half a pair", json.dumps({"kids": [P("a\ud800")]}), "x")]
    got = {r.doc_id: (r.ok, r.markdown) for r in rendered(spark.createDataFrame(rows, "doc_id string, element_json string, fallback_md string")).collect()}
    assert got == {k: (True, v[1]) for k, v in CASES.items()} | {k: (False, None) for k in ("broken", "deep", "half a pair")} | {"no tree": (True, "x")}


@pytest.mark.parametrize("element, level", [
    ({"heading level": 7, "font size": 16}, 2), ({"heading level": 7, "font size": 12}, 3), ({"heading level": 7, "font size": 9}, 4), ({"heading level": "abc"}, 1),
    ({"level": "H3"}, 3), ({}, 2), ({"heading level": None}, 1), ({"heading level": "2"}, 2), ({"heading level": 3.7}, 3), ({"heading level": 0}, 1),
])
def test_heading_level(element, level):
    assert tree.heading_level(element) == level


def test_cells_keep_their_places():
    row = lambda *cells: {"type": "table", "rows": [{"cells": list(cells)}, {"cells": [{"content": "x"}]}]}
    spanned = tree.render(row({"column number": 1, "content": "A", "column span": 2}, {"column number": 3, "content": "B"}))
    assert spanned.startswith("| A |  | B |")
    assert tree.render(row({"column number": 1, "content": "A"}, {"column number": 1, "content": "B"})).startswith("| A | B |")


MEDIUM = [["Coast", "Port", "Grain", "", "Timber", "", ""], ["", "", "In", "Out", "In", "Out", "State"], ["West", "Aldmouth", "31", "7", "5", "62", "Calm"], ["", "Brinsea", "18", "44", "3", "9", "Foggy"]]
MEDIUM_TEXT = (
    "**Table records:**\n- Coast: West; Port: Aldmouth; Grain > In: 31; Grain > Out: 7; Timber > In: 5; Timber > Out: 62; Timber > State: Calm\n"
    "- Coast: West; Port: Brinsea; Grain > In: 18; Grain > Out: 44; Timber > In: 3; Timber > Out: 9; Timber > State: Foggy"
)
MATRICES = [
    MEDIUM, [["H"] * 8, ["V"] * 8], [["x"] * 13], [[""], ["  "]], [["a<br>b", "c|d"], ["1\n2"]], [["A", "A", "B", "A", "", "n", "m", "o", "p", "q", "r", "s", "t"], ["1", "2", "3", "4", "5", "", "", "", "", "", "", "", "x"]],
    [[f"h{n}" for n in range(8)], ["long " * 60] * 8],
]


def test_tables_native_and_in_trees(spark):
    df = spark.createDataFrame([(n, m) for n, m in enumerate(MATRICES)], "n int, m array<array<string>>")
    native = [r.t for r in df.select("n", tables.render(F.col("m")).alias("t")).orderBy("n").collect()]
    assert native == [matrix.grid_or_records(m) for m in MATRICES]
    assert native[0] == MEDIUM_TEXT and native[2] == "" and native[3] == ""
    assert native[1].startswith("| H | H |")


PAGE = "--- Page 1 ---\n\n"
GATES = [  # rendered, markdown, allow, hybrid, native
    (None, "--- Page 1 ---\n\n--- Page 2 ---", False, None, None),
    (None, PAGE + "![x](y.png)", False, None, None),
    (None, PAGE + IMAGE_ONLY, False, None, None),
    (None, PAGE + IMAGE_ONLY, True, PAGE + IMAGE_ONLY, None),
    (PAGE + "# T\n\n**Image summary:** d", "# T\n\n![x](y)", False, PAGE + "# T\n\n**Image summary:** d", PAGE + "# T\n\n**Image summary:** d"),
    (PAGE + "# T\n\n" + VISUAL_PAGE, "# good text", False, None, None),
    (PAGE + "# T\n\n" + VISUAL_PAGE, "# T", True, PAGE + "# T\n\n" + VISUAL_PAGE, None),
    (None, "--- Page 26 ---\n\n| a | b |\n| --- | --- |\n| 1 | 2 |", False, "--- Page 26 ---\n\n| a | b |\n| --- | --- |\n| 1 | 2 |", "--- Page 26 ---\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"),
    (None, PAGE + "|  |  |\n| --- | --- |", False, None, None),
    (None, "\n\n".join(f"--- Page {n} ---" for n in range(20)) + "\n\ntext", False, "\n\n".join(f"--- Page {n} ---" for n in range(20)) + "\n\ntext", None),
    (None, None, False, None, None),
]


def test_gates(spark):
    df = spark.createDataFrame([(n, *g[:3]) for n, g in enumerate(GATES)], "n int, r string, m string, a boolean")
    h, v = gates.choose_rendered(F.col("r"), F.col("m"), F.col("a")), gates.choose_native(F.col("r"), F.col("m"))
    got = df.select("n", h["markdown"].alias("h"), v["markdown"].alias("v"), h["error"].alias("e")).orderBy("n").collect()
    assert [(r.h, r.v) for r in got] == [g[3:] for g in GATES]
    assert all((r.h is None) != (r.e is None) for r in got)


class Script:
    """Answers by source and mode."""

    def __init__(self, answers):
        self.answers, self.calls = answers, []

    def extract(self, docs, source, mode):
        text, error = self.answers.get((source, mode), (None, "broken xref"))
        self.calls.append((source, mode))
        return docs.select("doc_id", F.lit(error).alias("error"), F.lit(text).alias("markdown"), F.lit(None).cast("string").alias("rendered"))


OCR = "OCR fallback required"
CHAIN = [
    (True, {}, {(("light",), "auto"): ("md", None)}, (True, "md"), ""),
    (True, {"light_repair": False}, {(("full",), "auto"): ("md", None)}, (True, "md"), ""),
    (True, {"light_repair": False}, {(("full", "rasterized"), "full"): ("ocr md", None)}, (True, "ocr md"), ""),
    (True, {}, {((), "auto"): (None, OCR), (("rasterized",), "full"): ("ocr md", None)}, (True, "ocr md"), ""),
    (False, {}, {((), "auto"): (None, OCR)}, (False, None), NOT_SELECTED),
    (True, {}, {((), "auto"): (None, OCR), (("rasterized",), "full"): (None, "visual pages without OCR text")}, (False, None), AFTER_OCR),
]


@pytest.mark.parametrize("case", range(len(CHAIN)))
def test_chain(spark, case):
    use_ocr, options, answers, want, error = CHAIN[case]
    docs = spark.createDataFrame([("d", use_ocr)], "doc_id string, use_ocr boolean")
    result = convert(docs, Script(answers), Options(native_first=False, **options))
    row = result.first()
    assert (row.ok, row.markdown) == want
    assert (row.error or "").startswith(error)
    assert tuple(responses(result).first()) == ("d", want[0], want[1] or "")


def test_extractor_without_or_with_two_answers(spark):
    class Careless(Script):
        def extract(self, docs, source, mode):
            return super().extract(docs.filter("doc_id <> 'lost'").unionAll(docs.filter("doc_id = 'twice'")), source, mode)

    docs = spark.createDataFrame([("lost", False), ("twice", False)], "doc_id string, use_ocr boolean")
    got = {r.doc_id: r for r in convert(docs, Careless({((), "auto"): ("md", None)}), Options(native_first=False)).collect()}
    assert got["twice"].markdown == "md" and not got["lost"].ok and NO_ANSWER in got["lost"].error and len(got) == 2


SCRIPT = """
import pathlib, sys, time
file, out, mode = pathlib.Path(sys.argv[1]), pathlib.Path(sys.argv[2]), sys.argv[3]
text = file.read_text()
if mode == "repair":
    if "damaged" in text:
        out.write_text(text.replace("damaged", "mended"))
elif "slow" in text:
    time.sleep(60)
elif "damaged" in text:
    sys.exit("broken xref")
else:
    (out / "sub").mkdir()
    (out / "sub/a.md").write_text("# Report\\n\\n" + text.removeprefix("%PDF-") + " by " + mode)
    if "tree" in text:
        (out / "a.json").write_text('{"kids": [{"type": "heading", "level": 1, "content": "From the tree"}, {"type": "paragraph", "content": "of elements"}]}')
"""


def test_commands(spark, tmp_path):
    """The whole flow over files: uploads, checks, commands with repairs and a time limit, chunks."""
    (tmp_path / "tool.py").write_text(SCRIPT)
    (tmp_path / "in").mkdir()
    for name, text in {"good": "%PDF-good text", "bad": "%PDF-damaged text", "slow": "%PDF-slow text", "tree": "%PDF-tree", "none": "no signature"}.items():
        (tmp_path / f"in/{name}.pdf").write_text(text)
    files = uploads(spark, str(tmp_path / "in")).withColumn("doc_id", F.element_at(F.split("doc_id", "/"), -1))
    command = lambda mode: (sys.executable, str(tmp_path / "tool.py"), "{input}", "{output}", mode)
    options = Options(timeout_s=5, rasterize=False, full_repair=False)
    extractor = CommandExtractor(files, {"native": command("native"), "auto": command("auto")}, {"light": command("repair")}, options)
    got = {r.doc_id.removesuffix(".pdf"): r for r in converted(files, extractor, options).collect()}
    assert {k: r.ok for k, r in got.items()} == {"good": True, "bad": True, "slow": False, "tree": True, "none": False}
    assert "Content:\n\n# Report\n\ngood text by native" in got["good"].markdown and "mended text by native" in got["bad"].markdown
    assert "# From the tree\n\nof elements" in got["tree"].markdown and "more than 5 s" in got["slow"].error and got["none"].error == "no PDF signature"
    plain = converted(files.filter("doc_id = 'good.pdf'"), extractor, Options(timeout_s=5, chunk=False)).first()
    assert plain.markdown == "# Report\n\ngood text by native"


def test_validation(spark):
    rows = [("../bad:name?.pdf", b"not a pdf"), ("a.doc", b"%PDF-1" + b"\xef\xbf\xbd" * 200), ("", b" \n%PDF-1"), ("요강.pdf", b""), ("x.PDF", None)]
    got = validated(spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "doc_id int, filename string, content binary")).orderBy("doc_id").collect()
    assert [r.name for r in got] == ["bad_name_.pdf", "a.pdf", "document.pdf", "_.pdf", "x.PDF"]
    assert [r.reject_reason for r in got] == ["no PDF signature", "text-decoded or corrupted", None, "empty input", "empty input"]


def test_options(spark):
    for bad in ({"hybrid_mode": "off"}, {"max_bytes": 0}, {"chunking": ChunkingOptions(child_delimiter=" ")}, {"chunking": ChunkingOptions(child_overlap_chars=-1)}):
        with pytest.raises(ValueError):
            Options(**bad).checked()
    assert Options.from_conf(spark) == Options()


def test_artifacts(spark, tmp_path):
    for name, text in {"a/x/2.md": "two", "a/1.MD": "one", "a/z.json": "{}", "b/only.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert [tuple(r) for r in artifacts(spark, str(tmp_path)).collect()] == [("a", "one", "{}")]


def test_stream(spark, tmp_path):
    from quireflow.streaming.files import arriving_chunks

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# A\n\nbody")
    query = arriving_chunks(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("chunks").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    assert [r.content for r in spark.table("chunks").collect()] == ["# A\n\nbody"]


def test_orders_of_many_lines(spark, monkeypatch):
    matrix_ = [["a", "b"], *[[str(i), "x"] for i in range(1200)]]
    many = spark.createDataFrame([(1, matrix_)], "order_key long, matrix array<array<string>>")
    monkeypatch.setattr(queries.X, "order_matrices", lambda *_: many)
    assert queries.context_fill(spark, "").count() == 1200
