"""Files to text: parsers by name, tried in order until one succeeds."""

from __future__ import annotations

import csv
import html
import io
import json
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Parser = Callable[[bytes, str], str]
PARSERS: dict[str, Parser] = {}


def parser(name: str) -> Callable[[Parser], Parser]:
    def add(f: Parser) -> Parser:
        PARSERS[name] = f
        return f

    return add


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists and links of a page as Markdown."""

    skip = {"script", "style", "head", "noscript", "template"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.skip:
            self.hidden += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.parts.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.parts.append("\n- ")
        elif tag in ("p", "div", "section", "article", "ul", "ol", "table", "nav", "footer", "header", "blockquote"):
            self.parts.append("\n\n")
        elif tag in ("br", "tr"):
            self.parts.append("\n")
        elif tag in ("td", "th"):
            self.parts.append(" | ")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skip:
            self.hidden = max(0, self.hidden - 1)
        elif re.fullmatch(r"h[1-6]|p|div|section|article|ul|ol|table", tag):
            self.parts.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(re.sub(r"\s+", " ", data))


@parser("html")
def parse_html(data: bytes, name: str) -> str:
    text = data.decode("utf-8")
    if not re.search(r"<[a-zA-Z!]", text):
        raise ValueError("no markup")
    p = _Markdown()
    p.feed(text)
    p.close()
    return re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"\n{3,}", "\n\n", "".join(p.parts))).strip()


@parser("json")
def parse_json(data: bytes, name: str) -> str:
    return "```json\n" + json.dumps(json.loads(data), indent=2, ensure_ascii=False, sort_keys=True) + "\n```"


@parser("csv")
def parse_csv(data: bytes, name: str) -> str:
    if not name.lower().endswith((".csv", ".tsv")):
        raise ValueError("not a table by its name")
    rows = list(csv.reader(io.StringIO(data.decode("utf-8")), delimiter="\t" if name.lower().endswith(".tsv") else ","))
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in r) + " |"
    return "\n".join([line(rows[0]), "|" + "---|" * len(rows[0]), *map(line, rows[1:])]) if rows else ""


def _office(data: bytes, pattern: str, block: str) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=lambda n: [int(x) for x in re.findall(r"\d+", n)])
        if not names:
            raise ValueError("no such part")
        out = []
        for n in names:
            for p in re.split(block, z.read(n).decode("utf-8")):
                t = "".join(html.unescape(x) for x in re.findall(r"<(?:\w+:)?t(?:\s[^>]*)?>([^<]*)</(?:\w+:)?t>", p))
                if t.strip():
                    out.append(t.strip())
    return "\n\n".join(out)


@parser("docx")
def parse_docx(data: bytes, name: str) -> str:
    return _office(data, r"word/document\.xml", r"</w:p>")


@parser("pptx")
def parse_pptx(data: bytes, name: str) -> str:
    return _office(data, r"ppt/slides/slide\d+\.xml", r"</a:p>")


@parser("text")
def parse_text(data: bytes, name: str) -> str:
    text = data.decode("utf-8")
    if "\0" in text:
        raise ValueError("binary data")
    return text


def convert(data: bytes | None, name: str, chain: list[str]) -> tuple[str | None, str | None, str | None]:
    """(text, parser, errors) of the first parser of the chain that succeeds."""
    errors = []
    for p in chain:
        try:
            if data is None:
                raise ValueError("no content")
            return PARSERS[p](bytes(data), name), p, "; ".join(errors) or None
        except Exception as e:  # noqa: BLE001  any parser may fail on any file; the next is tried
            errors.append(f"{p}: {type(e).__name__}: {e}"[:200])
    return None, None, "; ".join(errors)


def convert_files(files: DataFrame, chain: list[str], name: str = "path", content: str = "content") -> DataFrame:
    """files with text, parser_used and parse_error, converted in Arrow batches."""
    unknown = [p for p in chain if p not in PARSERS]
    if unknown or not chain:
        raise ValueError(f"unknown parsers {unknown} in {chain}")

    @F.pandas_udf("text string, parser_used string, parse_error string")
    def run(data: pd.Series, names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([convert(d, n or "", chain) for d, n in zip(data, names, strict=True)], columns=["text", "parser_used", "parse_error"])

    return files.withColumn("__c", run(F.col(content), F.col(name))).select(*files.columns, "__c.*")


def _blob(spark: SparkSession, root: str, name: str):
    """(file system, path) of a blob; names stay inside the root."""
    if not name or name.startswith("/") or ".." in name.split("/"):
        raise ValueError(f"not a name inside the store: {name!r}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def put_blob(spark: SparkSession, root: str, name: str, data: bytes) -> str:
    """Stores one blob on any Hadoop file system, in place of one of that name, and returns its address."""
    fs, path = _blob(spark, root, name)
    out = fs.create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return fs.makeQualified(path).toString()


def has_blob(spark: SparkSession, root: str, name: str) -> bool:
    fs, path = _blob(spark, root, name)
    return fs.exists(path)


def drop_blob(spark: SparkSession, root: str, name: str) -> bool:
    """Deletes a blob; false where there was none."""
    fs, path = _blob(spark, root, name)
    return fs.delete(path, False)


def read_files(spark: SparkSession, path: str, chain: list[str], pattern: str = "*") -> DataFrame:
    """Files of any Hadoop file system as text."""
    return convert_files(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path), chain)
