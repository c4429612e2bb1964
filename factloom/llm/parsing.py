"""Source files that don't parse in the language of their extension.

Every file is first reduced to lexer states and brackets (see brackets): its chunks' maps are combined associatively.
Files above BIG characters are cut up where they are read and their chunks summarised by other tasks, then combined a
file; the result is the same. What ends in code with all brackets matched is read by the language's local grammar (see
grammar), at any depth. The table is scanned once; only keys, verdicts and chunks of files above BIG are written.

Defined results: null and empty contents and other extensions are no cases. A byte-order mark is ignored. Only a Python
statement that is by itself nested too deeply for the parser counts as valid once its brackets match. Repeated rows of an
item count once, and as a case if any of them is one. Items without repository, scan or path are judged like others. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import cut
from . import brackets, grammar

#: Characters above which a file's chunks are summarised by several tasks.
BIG = 1_000_000
#: Extensions and the names of their languages.
LANGUAGES = {"cs": "csharp", "ts": "typescript", "js": "javascript", "py": "python", "java": "java", "sql": "sql", "json": "json", "config": "xml"}
KEYS = ["scan_id", "repo", "relative_path"]


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def plain(text: str) -> str:
    return text[1:] if text[:1] == "﻿" else text


def whole(text: str, lang: str) -> brackets.Part:
    """The file's part, its chunks' maps combined."""
    maps = [brackets.state_map(c, lang, i) for i, c in enumerate(brackets.chunks(text))]
    return reduce(brackets.combine, maps)["code"]


def parses(text: str | None, lang: str) -> bool:
    """Whether a file's text is valid for its extension."""
    if not text:
        return True
    text = plain(text)
    if lang != "config" and not brackets.balanced(whole(text, lang)):
        return False
    return grammar.reads(text, lang)


STAGE = "scan_id string, repo string, relative_path string, lang string, ok boolean, id string, i int, chunk string"


def _stage(big: int):
    """Verdicts of the files up to `big` characters, and chunks of the others under their item's and content's id."""
    columns = [x.split()[0] for x in STAGE.split(", ")]

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out: list[tuple] = []
            for *keys, lang, text in pdf[[*KEYS, "lang", "content"]].itertuples(index=False, name=None):
                if len(text) <= big:
                    out.append((*keys, lang, parses(text, lang), None, None, None))
                    continue
                id_ = hashlib.sha256(repr((*keys, text)).encode("utf-8", "surrogatepass")).hexdigest()
                pieces = [plain(text)] if lang == "config" else brackets.chunks(plain(text))
                for i, c in enumerate(pieces):
                    yield pd.DataFrame([(*keys, lang, None, id_, i, c)], columns=columns)
            if out:
                yield pd.DataFrame(out, columns=columns)

    return judge


def _summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = pdf[["id", "i"]].copy()
        out["part"] = [pickle.dumps(brackets.state_map(c, x, i)) for c, x, i in zip(pdf["chunk"], pdf["lang"], pdf["i"])]
        yield out


def _reduce(pdf: pd.DataFrame) -> pd.DataFrame:
    maps = [pickle.loads(x) for x in pdf.sort_values("i")["part"]]
    done = brackets.balanced(reduce(brackets.combine, maps)["code"])
    return pdf.head(1)[["id"]].assign(balanced=done)


def _read(pdf: pd.DataFrame) -> pd.DataFrame:
    """A file's chunks put together again and read; it was one row before."""
    text = "".join(pdf.sort_values("i")["chunk"])
    head = pdf.head(1)
    return head[[*KEYS, "lang"]].assign(ok=grammar.reads(text, head["lang"].iloc[0]))


def judged(files: DataFrame, big: int = BIG) -> DataFrame:
    """(scan_id, repo, relative_path, lang, ok), one row for each item with content of a known extension."""
    src = files.where(F.col("content").isNotNull() & (F.col("content") != "")).select(*KEYS, "content", extension("relative_path").alias("lang")).where(F.col("lang").isin(*LANGUAGES))
    staged = cut(src.mapInPandas(_stage(big), STAGE))
    every = staged.where("ok is not null").select(*KEYS, "lang", "ok")
    pieces = staged.where("ok is null").dropDuplicates(["id", "i"])
    if pieces.limit(1).count():
        # A file's summaries are far smaller than the file, which was one row itself.
        shapes = cut(pieces.where(F.col("lang") != "config").select("id", "i", "lang", "chunk").mapInPandas(_summarise, "id string, i int, part binary").groupBy("id").applyInPandas(_reduce, "id string, balanced boolean"))
        broken = shapes.where(~F.col("balanced")).select("id")
        every = every.unionByName(pieces.where("i = 0").join(broken, "id", "left_semi").select(*KEYS, "lang", F.lit(False).alias("ok")))
        read = pieces.join(broken, "id", "left_anti").groupBy("id").applyInPandas(_read, "scan_id string, repo string, relative_path string, lang string, ok boolean")
        every = every.unionByName(read)
    return every.groupBy(*KEYS, "lang").agg(F.min("ok").alias("ok"))


def rates(found: DataFrame) -> DataFrame:
    """Files and invalid ones a repository and language."""
    language = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[F.col("lang")]
    bad = (~F.col("ok")).cast("long")
    return found.groupBy("repo", language.alias("language")).agg(F.count(F.lit(1)).alias("n_files"), F.sum(bad).alias("n_invalid"), F.round(F.avg(bad), 6).alias("rate"))
