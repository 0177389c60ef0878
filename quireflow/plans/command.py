"""An extractor that runs configured commands on each document, with repairs before them."""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..options import Options
from ..sources.files import ELEMENTS, MARKDOWN
from ..sources.shared import staged
from .convert import rendered

ANSWER = "doc_id string, error string, markdown string, element_json string"


@dataclass(frozen=True)
class CommandExtractor:
    """Answers by commands, one process for each document at a time, in Arrow batches.

    ``commands`` has the words of a command for each mode (native, auto, full), ``repairs`` for each repair (light,
    full, rasterized).  In the words, {input} is the file, {output} the folder for artifacts, or the file that a
    repair has to write; {timeout_ms}, {dpi} and the extractor's options stand for their values.  A repair that is
    not configured, fails or writes nothing leaves the file as it was.  A document that takes too long, or whose
    command fails, gets that as its error; it fails alone.  The files of a document live in its worker, as long as
    its commands run; results go through the shared folder.
    """

    uploads: DataFrame
    commands: Mapping[str, tuple[str, ...]]
    repairs: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    options: Options = Options()

    def extract(self, docs: DataFrame, source: tuple[str, ...], mode: str) -> DataFrame:
        commands, repairs, options = dict(self.commands), dict(self.repairs), self.options
        limit = options.timeout_s if mode == "native" else min(options.timeout_s, options.hybrid_timeout_ms / 1000)
        values = dict(options.extractor) | {"timeout_ms": options.hybrid_timeout_ms, "dpi": options.rasterize_dpi}

        def run(words: tuple[str, ...], **paths: Path) -> str | None:
            """The reason why a command failed, or None."""
            try:
                done = subprocess.run([w.format(**values, **paths) for w in words], stdin=subprocess.DEVNULL, capture_output=True, timeout=limit)
            except subprocess.TimeoutExpired:
                return f"{mode} extraction took more than {limit:g} s"
            except OSError as e:
                return f"{mode} extraction could not start: {e.strerror}"
            said = (done.stderr or done.stdout).decode("utf-8", "replace").strip()
            return None if done.returncode == 0 else f"{mode} extraction failed ({done.returncode}): {said[-500:]}"

        def first(folder: Path, kinds: tuple[str, ...]) -> str | None:
            found = sorted(p for p in folder.rglob("*") if p.is_file() and p.suffix.lower().lstrip(".") in kinds)
            return found[0].read_bytes().decode("utf-8", "replace") if found else None

        def answer(content: bytes | None) -> tuple[str | None, str | None, str | None]:
            with tempfile.TemporaryDirectory() as home:
                file, out = Path(home, "input.pdf"), Path(home, "out")
                file.write_bytes(content or b"")
                out.mkdir()
                for step in source:
                    made = Path(home, f"{step}.pdf")
                    if step in repairs and run(repairs[step], input=file, output=made) is None and made.is_file() and made.stat().st_size:
                        file = made
                error = run(commands[mode], input=file, output=out) if mode in commands else f"no command for {mode} extraction"
                return (error, None, None) if error else (None, first(out, MARKDOWN), first(out, ELEMENTS))

        def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    made = answer(batch.column(1)[at].as_py())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), *(pa.array([x], pa.string()) for x in made)], ["doc_id", "error", "markdown", "element_json"])

        asked = docs.select("doc_id").join(self.uploads.select("doc_id", "content"), "doc_id")
        rows = staged(asked.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(answers, ANSWER), "answers")
        trees = rendered(rows.filter("element_json is not null").select("doc_id", "element_json", F.lit("").alias("fallback_md")))
        return rows.join(trees.filter("ok").select("doc_id", F.nullif("markdown", F.lit("")).alias("rendered")), "doc_id", "left").select("doc_id", "error", "markdown", "rendered")
