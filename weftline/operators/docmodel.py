"""Structured documents: Markdown to sections and blocks and back, and edits by small operations."""

from __future__ import annotations

import copy
import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_BULLET = re.compile(r"^\s*[-*+]\s+(.*)$")
_NUMBER = re.compile(r"^\s*\d+[.)]\s+(.*)$")


def slug(heading: str, taken: set[str]) -> str:
    """An id from a heading, unique among those taken."""
    base = re.sub(r"[^a-z0-9]+", "-", heading.lower()).strip("-") or "section"
    out, n = base, 2
    while out in taken:
        out, n = f"{base}-{n}", n + 1
    taken.add(out)
    return out


def parse(markdown: str) -> dict:
    """Sections (id, heading, level) of blocks: paragraph, bullet_list, ordered_list, code."""
    doc, taken = {"sections": []}, set()
    section, open_block = None, None

    def need() -> dict:
        nonlocal section
        if section is None:
            section = {"id": slug("intro", taken), "heading": "", "level": 0, "blocks": []}
            doc["sections"].append(section)
        return section

    lines = (markdown or "").split("\n")
    k = 0
    while k < len(lines):
        line = lines[k]
        k += 1
        if line.startswith("```"):
            body = []
            while k < len(lines) and not lines[k].startswith("```"):
                body.append(lines[k])
                k += 1
            k += 1
            need()["blocks"].append({"type": "code", "language": line[3:].strip(), "text": "\n".join(body)})
            open_block = None
        elif m := _HEADING.match(line):
            section = {"id": slug(m[2], taken), "heading": m[2], "level": len(m[1]), "blocks": []}
            doc["sections"].append(section)
            open_block = None
        elif not line.strip():
            open_block = None
        else:
            kind, item = ("bullet_list", _BULLET.match(line)) if _BULLET.match(line) else ("ordered_list", _NUMBER.match(line)) if _NUMBER.match(line) else ("paragraph", None)
            if open_block is None or open_block["type"] != kind:
                open_block = {"type": kind, "text": ""} if kind == "paragraph" else {"type": kind, "items": []}
                need()["blocks"].append(open_block)
            if item:
                open_block["items"].append(item[1].strip())
            else:
                open_block["text"] = (open_block["text"] + "\n" + line).strip("\n")
    return doc


def render(doc: dict) -> str:
    out = []
    for s in doc["sections"]:
        if s["level"]:
            out.append("#" * s["level"] + " " + s["heading"])
        for b in s["blocks"]:
            match b["type"]:
                case "bullet_list":
                    out.append("\n".join(f"- {i}" for i in b["items"]))
                case "ordered_list":
                    out.append("\n".join(f"{n}. {i}" for n, i in enumerate(b["items"], 1)))
                case "code":
                    out.append(f"```{b.get('language', '')}\n{b['text']}\n```")
                case _:
                    out.append(b["text"])
    return "\n\n".join(out)


#: Operations on blocks, with the highest index each takes: None for no index, else how far beyond the last block.
_BLOCK_OPS = {"append_block": None, "insert_block": 1, "replace_block": 0, "remove_block": 0}
_SECTION_OPS = {"remove_section", "rename_section", "replace_section_blocks"}


def _refusal(op: dict, ids: list[str], blocks: list) -> str | None:
    """Why an operation cannot be applied."""
    kind, at = op.get("op"), op.get("index")
    if kind == "add_section":
        after = op.get("after_section_id")
        if not op.get("heading"):
            return "no heading"
        return f"unknown after_section_id: {after}" if after is not None and after not in ids else None
    if kind not in _BLOCK_OPS and kind not in _SECTION_OPS:
        return f"unknown operation {kind}"
    if op.get("section_id") not in ids:
        return f"unknown section_id: {op.get('section_id')}"
    if kind == "rename_section" and not isinstance(op.get("new_heading"), str):
        return "no new_heading"
    beyond = _BLOCK_OPS.get(kind)
    if beyond is not None and not (isinstance(at, int) and 0 <= at < len(blocks) + beyond):
        return f"index out of range: {at}"
    if kind in ("append_block", "insert_block", "replace_block") and not isinstance(op.get("block"), dict):
        return "no block"
    return None


def apply(doc: dict, operations: list[dict]) -> tuple[dict, list[str]]:
    """A new document with the operations applied in order, and why others were skipped.

    Blocks: append_block, insert_block, replace_block, remove_block (section_id, index, block). Sections: add_section
    (heading, level, blocks, after_section_id, new_id), remove_section, rename_section (new_heading; the id stays),
    replace_section_blocks (blocks). Sections that none names stay as they are, and so does doc.
    """
    new, skipped = copy.deepcopy(doc), []
    sections = new["sections"]
    for n, op in enumerate(copy.deepcopy(operations)):
        ids = [s["id"] for s in sections]
        where = ids.index(op["section_id"]) if op.get("section_id") in ids else None
        blocks = sections[where]["blocks"] if where is not None else []
        if why := _refusal(op, ids, blocks):
            skipped.append(f"{n}: {why}")
            continue
        match op["op"], op.get("index"):
            case "add_section", _:
                own = slug(op.get("new_id") or op["heading"], set(ids))
                after = op.get("after_section_id")
                sections.insert(len(ids) if after is None else ids.index(after) + 1, {"id": own, "heading": op["heading"], "level": op.get("level", 2), "blocks": op.get("blocks", [])})
            case "append_block", _:
                blocks.append(op["block"])
            case "insert_block", at:
                blocks.insert(at, op["block"])
            case "replace_block", at:
                blocks[at] = op["block"]
            case "remove_block", at:
                del blocks[at]
            case "remove_section", _:
                del sections[where]
            case "rename_section", _:
                sections[where]["heading"] = op["new_heading"]
            case "replace_section_blocks", _:
                sections[where]["blocks"] = op.get("blocks", [])
    return new, skipped


@F.udf(StringType(), useArrow=False)
def parse_markdown(text: str) -> str:
    """As JSON. Texts go to Python a hundred at a time: an Arrow batch of ten thousand would be held as texts, documents and JSON at once."""
    return json.dumps(parse(text), ensure_ascii=False)


@F.pandas_udf(StringType())
def apply_operations(doc: pd.Series, operations: pd.Series) -> pd.Series:
    """Both as JSON; the result too, with what was skipped."""

    def one(d: str, o: str) -> str:
        new, skipped = apply(json.loads(d), json.loads(o))
        return json.dumps({"document": new, "skipped": skipped}, ensure_ascii=False)

    return pd.Series([one(d, o) for d, o in zip(doc, operations, strict=True)])
