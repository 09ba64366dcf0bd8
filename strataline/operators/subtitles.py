"""Subtitle and meeting-transcript files into cues, speakers and durations."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A cue's time line, markup inside cues, header lines, a line that is only a sound.
TIME = re.compile(r"(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})\s*-->")
END = re.compile(r"-->\s*(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})")
MARKUP = re.compile(r"<[^>]+>")
HEADERS = ("WEBVTT", "Kind:", "Language:")
SOUND = re.compile(r"^\[[^\]]*\]$")
VOICE = re.compile(r"<v(?:\.[\w.-]+)*\s+([^>]+?)\s*>")
OVERRIDE = re.compile(r"\{\\[^}]*\}")
LANGUAGE = re.compile(r"(?m)^Language:\s*(\S+)")
#: Fixed value: a name that opens a cue (Java pattern).
SPEAKER = r"(?U)^([\p{L}][\w'.-]*(?: [\p{L}][\w'.-]*){0,3}):\s"


def seconds(parts) -> float:
    h, m, s, ms = (int(p or 0) for p in parts)
    return h * 3600 + m * 60 + s + ms / 1000


def cues(text: str, dedupe: bool) -> list[tuple[float, str]]:
    """(start, text) of every text line below a time line; comments, headers and identifiers are none."""
    found: list[tuple[float, str]] = []
    for block in re.split(r"\n[ \t\r\f\v]*\n", "\n".join(text.splitlines())):
        start = None
        for line in map(str.strip, block.split("\n")):
            if line.startswith("NOTE"):
                break
            if hit := TIME.match(line):
                start = seconds(hit.groups())
            elif start is not None and line and not line.startswith(HEADERS):
                plain = html.unescape(MARKUP.sub("", line)).strip()
                if plain and not SOUND.match(plain) and not (dedupe and found and found[-1][1] == plain):
                    found.append((start, plain))
    return found


def decode(raw: bytes) -> str:
    """UTF-8 (with or without mark), else Windows-1252."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1252", errors="replace")


def parse_cues(files: DataFrame, id_col: str, text: str, dedupe: bool = True) -> DataFrame:
    """(id, cue_ord, start_s, text) of every cue; dedupe drops a cue that repeats the one before."""

    def run(batches):
        for b in batches:
            ids, ords, starts, texts = [], [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for k, (s, t) in enumerate(cues(x.as_py() or "", dedupe), 1):
                    ids.append(i)
                    ords.append(k)
                    starts.append(s)
                    texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(ords, pa.int64()), pa.array(starts, pa.float64()), pa.array(texts, pa.string())], [id_col, "cue_ord", "start_s", "text"])

    return files.select(id_col, text).mapInArrow(run, f"{id_col} {dict(files.dtypes)[id_col]}, cue_ord long, start_s double, text string")


def parse_transcripts(files: DataFrame, id_col: str, content: str) -> DataFrame:
    """(id, language, duration_s, voices, cues) of subtitle files as bytes; voice tags become ``Name: `` prefixes."""

    def one(raw: bytes) -> dict:
        text = OVERRIDE.sub("", decode(raw or b""))
        voices = list(dict.fromkeys(VOICE.findall(text)))
        own = cues(VOICE.sub(lambda m: m[1] + ": ", text), dedupe=False)
        ends = [seconds(m.groups()) for m in END.finditer(text)]
        head = LANGUAGE.search(text.split("-->", 1)[0])
        last = int(own[-1][0]) + 1 if own else 0
        return {"language": head[1] if head else None, "duration_s": max([last, *map(int, ends)]), "voices": voices, "cues": [{"start_s": s, "text": t} for s, t in own]}

    def run(batches):
        kind = pa.struct([("language", pa.string()), ("duration_s", pa.int64()), ("voices", pa.list_(pa.string())), ("cues", pa.list_(pa.struct([("start_s", pa.float64()), ("text", pa.string())])))])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *pa.array([one(x.as_py()) for x in b.column(1)], kind).flatten()], [id_col, "language", "duration_s", "voices", "cues"])

    return files.select(id_col, content).mapInArrow(run, f"{id_col} {dict(files.dtypes)[id_col]}, language string, duration_s long, voices array<string>, cues array<struct<start_s:double,text:string>>")


def speakers(cue_rows: DataFrame, by: str) -> DataFrame:
    """(by, name, n, position) of speakers, by first appearance: a capitalised prefix of two cues, or a voiced name.

    cue_rows: by, ord, text, voiced (the cue's name came from a voice tag).
    """
    from pyspark.sql import Window

    named = cue_rows.withColumn("name", F.regexp_extract("text", SPEAKER, 1)).filter("name <> ''")
    capital = F.forall(F.split("name", " "), lambda t: F.upper(F.substring(t, 1, 1)) == F.substring(t, 1, 1))
    counted = named.filter(capital).groupBy(by, "name").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.bool_or("voiced").alias("voiced"))
    kept = counted.filter("voiced or n >= 2")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("first"))).drop("first", "voiced")
