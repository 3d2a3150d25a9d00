"""Markdown structure of one document, as plain functions for Arrow maps: blocks, packing, splitting, merging, cleaning."""

from __future__ import annotations

import re

_FENCE = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})[ \t]*([^\s`]*)")
_OCR_OPEN, _OCR_CLOSE = re.compile(r"^\*\[Image OCR\]\*\s*$"), re.compile(r"^\*\[End OCR\]\*\s*$")
_MATH, _TABLE = re.compile(r"^\s*\$\$\s*$"), re.compile(r"^\s*\|.*\|\s*$")
_LIST = re.compile(r"^(\s*(?:\*|-|\+|\d+[.)])\s+)(.*)")
_CJK = "\u4e00-\u9fff"
_HAS_CJK, _STARTS_CJK = re.compile(f"[{_CJK}]"), re.compile(f"[{_CJK}]{{2,}}")
_HEADING = re.compile(r"(#{1,6})\s+(.*)", re.A)


def opener(line: str) -> str | None:
    """The kind of block that a line starts, or None for text."""
    for kind, pattern in (("ocr", _OCR_OPEN), ("code", _FENCE), ("math", _MATH), ("table", _TABLE)):
        if pattern.match(line):
            return kind
    return None


def closes(line: str, fence: str) -> bool:
    m = _FENCE.match(line)
    return bool(m) and m[1][0] == fence[0] and len(m[1]) >= len(fence)


def sections(text: str) -> list[dict]:
    """header_path, line_start, text of the heading sections of a text that aren't blank, as markdown.sections() has them."""
    lines, stack, out = text.splitlines(), [], []
    heads = [(i, m) for i, x in enumerate(lines) if x.startswith("#") and (m := _HEADING.fullmatch(x))]
    for (i, m), end in zip([(-1, None), *heads], [*(i for i, _ in heads), len(lines)]):
        if m:
            stack = [h for h in stack if h[0] < len(m[1])] + [(len(m[1]), m[2].strip())]
        body = "\n".join(lines[i + 1:end])
        if body.strip():
            out.append({"header_path": "/" + "".join(f"{t}/" for _, t in stack), "line_start": i + 1, "text": body})
    return out


def blocks(lines: list[str]) -> list[dict]:
    """Typed blocks: type, text, start and end (half-open, with the marks), code_language, fence_char, fence_len.

    A block without its closing mark runs to the end and loses nothing. Blank lines between blocks belong to none.
    """
    out, i, n = [], 0, len(lines)
    while i < n:
        if not lines[i].strip():
            i += 1
            continue
        kind, start, extra = opener(lines[i]), i, {}
        if kind == "table":
            while i < n and _TABLE.match(lines[i]):
                i += 1
            body = lines[start:i]
        elif kind:
            m = _FENCE.match(lines[i]) if kind == "code" else None
            ends = (lambda x: closes(x, m[1])) if m else (_MATH if kind == "math" else _OCR_CLOSE).match  # noqa: B023
            i += 1
            while i < n and not ends(lines[i]):
                i += 1
            closed = i < n
            i += closed
            body = lines[start:i] if not m else lines[start + 1:i - closed]
            extra = {"code_language": m[2] or None, "fence_char": m[1][0], "fence_len": len(m[1])} if m else {}
        else:
            while i < n and opener(lines[i]) is None:
                i += 1
            body = lines[start:i]
        if kind or "\n".join(body).strip():
            out.append({"type": kind or "text", "text": "\n".join(body), "start": start, "end": i, **extra})
    return out


def pack(lines: list[str], limit: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of lines that joined by \\n stay within limit; a longer line is a stretch by itself."""
    out, a, size = [], 0, -1
    for i, line in enumerate(lines):
        if i > a and size + 1 + len(line) > limit:
            out.append((a, i))
            a, size = i, -1
        size += 1 + len(line)
    return out + [(a, len(lines))] if lines else out


def text_nodes(block: dict, base: int, size: int) -> list[dict]:
    """Nodes of a block with absolute line ranges: text packed to size, others whole."""
    start = base + block["start"]
    if block["type"] != "text":
        return [{**block, "line_start": start, "line_end": base + block["end"]}]
    lines = block["text"].split("\n")
    return [{**block, "text": t, "line_start": start + a, "line_end": start + b} for a, b in pack(lines, size) if (t := "\n".join(lines[a:b])).strip()]


def split_table(node: dict, size: int, tolerance: int = 300) -> list[dict]:
    """Pieces of whole rows, each with header and a banner that counts rows; without a separator row, the table as it is."""
    lines = node["text"].split("\n")
    sep = next((i for i, x in enumerate(lines) if "|" in x and "-" in x), 0)
    if len(lines) < 3 or sep in (0, len(lines) - 1):
        return [node]
    fixed, rows = lines[:sep + 1], lines[sep + 1:]
    head, cuts, have = len("\n".join(fixed)), [0], 0
    for i, row in enumerate(rows):
        if i > cuts[-1] and head + have + 1 + len(row) > size + tolerance:
            cuts.append(i)
            have = 0
        have += 1 + len(row)
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(rows)]):
        banner = f"【表格 第 {a + 1}-{b} 行，共 {len(rows)} 行】\n"
        first = node["line_start"] + len(fixed)
        out.append({**node, "text": "\n".join([banner, *fixed, *rows[a:b]]), "line_start": first + a, "line_end": first + b, "table_row_start": a, "table_row_end": b - 1, "relative_row_start": a + 1, "relative_row_end": b})
    return out


def split_code(node: dict, size: int) -> list[dict]:
    """Fenced again with its own fence and language; over 1.5 sizes, in pieces of whole lines with a banner each.

    Line ranges of pieces count code lines only (the fence line is not the first).
    """
    text, fence = node["text"], (node.get("fence_char") or "`") * max(3, int(node.get("fence_len") or 3))
    if not text.strip():
        return [node]
    lines = text.split("\n")
    if len(text) <= 1.5 * size:
        cuts, split = [(0, len(lines))], False
    else:
        cuts, split, a, have = [], True, 0, 0
        for i, line in enumerate(lines):
            if i > a and have + len(line) + 1 > size:
                cuts.append((a, i))
                a, have = i, 0
            have += len(line) + 1
        cuts.append((a, len(lines)))
    out = []
    for k, (a, b) in enumerate(cuts):
        body = "\n".join(lines[a:b]).rstrip("\n")
        banner = f"【代码块 第 {a + 1}-{b} 行，共 {len(lines)} 行】\n" if split else ""
        lines_at = (node["line_start"] + 1 + a, node["line_start"] + 1 + b) if split else (node["line_start"], node["line_end"])
        out.append({**node, "text": f"{banner}{fence}{node.get('code_language') or ''}\n{body}\n{fence}", "line_start": lines_at[0], "line_end": lines_at[1], "code_chunk_index": k, "code_total_chunks": len(cuts), "is_code_split": split, "relative_line_start": a + 1, "relative_line_end": b})
    return out


def split_text(node: dict, size: int, tolerance: int = 80) -> list[dict]:
    lines = node["text"].split("\n")
    if len(node["text"]) <= size + tolerance:
        return [node]
    return [{**node, "text": t, "line_start": node["line_start"] + a, "line_end": node["line_start"] + b} for a, b in pack(lines, size + tolerance) if (t := "\n".join(lines[a:b])).strip()]


#: What splits a block of each type; other types pass as they are. Callers may add their own.
HANDLERS = {"text": lambda n, s: split_text(n, s), "table": lambda n, s: split_table(n, s), "code": lambda n, s: split_code(n, s), "math": lambda n, s: [n], "ocr": lambda n, s: [n]}


def is_title_only(text: str) -> bool:
    t = text.strip()
    return t.startswith("#") and "\n" not in t


def candidate(node: dict) -> dict:
    return {**node, "text": f"[SECTION]\n{node['header_path'].strip('/').replace('/', ' > ')}\n\n[CONTENT]\n{node['text']}"}


def parent(path: str) -> str:
    parts = [p for p in path.split("/") if p]
    return "/" + "".join(p + "/" for p in parts[:-1])


def relative(above: str, path: str) -> str:
    if not path.startswith(above):
        return path
    rest = path[len(above):]
    return "/" + rest if rest else ""


def merge(nodes: list[dict], size: int) -> list[dict]:
    """Joins a file's small chunks in order: one under 0.75 sizes takes its followers of the same parent or below it, while
    the whole stays within 1.5 sizes. Block types are those of the chunks that went in."""
    out, i = [], 0
    while i < len(nodes):
        first, parts, j = nodes[i], [nodes[i]], i + 1
        text = first["text"]
        if len(text) < 0.75 * size:
            while j < len(nodes) and len(text) < 1.5 * size:
                x = nodes[j]
                if x["text"].strip():
                    near = parent(x["header_path"]) == parent(first["header_path"]) or x["header_path"].startswith(first["header_path"])
                    if not near or len(text) + 2 + len(x["text"]) > 1.5 * size:
                        break
                    text += "\n\n" + x["text"]
                    parts.append(x)
                j += 1
        got = {**first, "text": text, "block_types": sorted({t for p in parts for t in p["block_types"]})}
        if len(parts) > 1:
            got |= {"line_end": parts[-1]["line_end"], "merged_chunks": len(parts), "merged_headers": [relative(parent(first["header_path"]), p["header_path"]) for p in parts]}
        out.append(got)
        i = j if len(parts) > 1 else i + 1
    return out


# ---------------------------------------------------------------- cleaning


def fence_flags(lines: list[str]) -> list[bool]:
    """Is each line inside a fenced block? Its opening line isn't, its closing line is."""
    out, fence = [], None
    for line in lines:
        out.append(fence is not None)
        m = _FENCE.match(line)
        if fence is None:
            fence = m[1] if m else None
        elif m and closes(line, fence):
            fence = None
    return out


def bare_cjk(text: str) -> bool:
    """Is there an ideograph outside of quotes and comments?"""
    if not _HAS_CJK.search(text):
        return False
    literal = r"\"(?:\\.|[^\"\\])*(?:\"|\\?$)|'(?:\\.|[^'\\])*(?:'|\\?$)|/\*.*?(?:\*/|$)|(?:#|//).*$"
    return bool(re.search(f"[{_CJK}]", re.sub(literal, " ", text, flags=re.S)))


def paired_marker(text: str) -> bool:
    """** or == right before text, and again right after text."""
    for m in ("**", "=="):
        a = text.find(m)
        b = text.find(m, a + 2) if a >= 0 else -1
        if b >= 0 and text[a + 2] != " " and text[b - 1] != " ":
            return True
    return False


# What is never code, and what is.
NOT_CODE = (
    rf"^[{_CJK}]{{2,}}", r"^#{1,6}\s+", r"^[-*+]\s+", r"^\d+[.)]\s+", r"\|.*\|", r"^\$\$", r"\$\$$", r"\$.*\$", r"^>", r"^[-*_]{3,}\s*$", r"^<!--.*-->$", r"^!\[.*\]\(.*\)", r"^\[[^\]]+\]\([^)]+\)",
)
CODE_WORDS = (
    r"\bdef\s+\w+\s*\(", r"\bclass\s+\w+", r"\bfunction\s+\w+\s*\(", r"\bif\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bimport\s+", r"\bfrom\s+\w+\s+import", r"\breturn\s+", r"\bexport\s+",
    r"\b(?:sudo|docker|git|apt|yum|npm|yarn|pip|conda|curl|wget|ssh|scp|rsync)\s+",
)
SQL_WORDS = (r"\b(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|JOIN|HAVING|LIMIT|UNION|INTO)\s+", r"\b(?:ORDER|GROUP)\s+BY", r"\bVALUES\s*\(", r"\bSET\s+\w+\s*=")
CODE_SIGNS = (
    r"=\s*\?\s*$", r"[-=]>", r"&(?:lt|gt|amp|quot|#39|#x?\w+);", r"^\d+\.\s*\w+:", r"^[{\[].*[}\]]\s*$", r"</?\w+[^>]*>", r"^[A-Za-z_][A-Za-z0-9_]*\s*\(.*\)\s*;?\s*$", r"^[$#>]\s+", r"^\[.*\]\s*[#$>]\s+",
    r"^[\w\-.]+@[\w\-.]+:.*[$#>]\s+", r"^\$?\s*\w+\s*\|", r"https?://\S+\?\S+=\S+", r"^[/\\]?(?:[\w\-]+[/\\])+[\w\-]+\.\w+", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", r"^[A-Z_][A-Z0-9_]*=", r"^[\w\-.]+@[\w\-.]+",
)
CODE_SIGNS_ANY_CASE = (r"^(?:void|int|char|float|double|long|static|const|virtual|class|struct)\s+\w+\s*\([^)]*\)\s*\{?\s*$", r"^(?:sip|tel|mailto|ftp)://?")
_NEVER = re.compile("|".join(f"(?:{p})" for p in NOT_CODE))
_CODE = re.compile("|".join(f"(?:{p})" for p in (*CODE_WORDS, *CODE_SIGNS)))
_CODE_ANY_CASE = re.compile("|".join(f"(?:{p})" for p in (*SQL_WORDS, *CODE_SIGNS_ANY_CASE)), re.I)
#: Every sign of code has one of these characters or words; a line without any needs no further look.
_MARK = re.compile(r"[=<>&:{}\[\](/\\@|;$#]|\d\.\d")
_WORDS = re.compile(r"\w+")
_KEYWORDS = frozenset(
    "def class function if for while import from return export sudo docker git apt yum npm yarn pip conda curl wget ssh scp rsync "
    "select insert update delete where join having limit union into order group values set".split()
)
_SYNTAX = re.compile(r"^(?:!\[.*\]\(.*\)|\[[^\]]+\]\([^)]+\)|#{2,6}\s+|[-*+]\s+|\d+[.)]\s+|\|(?:.*\|)?$|>)")


def cjk_share(s: str) -> float:
    return len(_HAS_CJK.findall(s)) / max(1, len(s))


def code_like(line: str) -> bool:
    """Does a line look like code, configuration, markup or a shell session?"""
    s = line.lstrip()
    if not s or not _MARK.search(s) and _KEYWORDS.isdisjoint(_WORDS.findall(s.lower())):
        return False
    if paired_marker(s) or bare_cjk(s) or _NEVER.search(s):
        return False
    if _CODE.search(s) or _CODE_ANY_CASE.search(s):
        return True
    plain = not _HAS_CJK.search(s)
    return (  # fixed values: the signs that count only together with others
        plain and bool(re.match(r"\w+\s*=\s*.+", s))
        or plain and len(s.split()) <= 5 and bool(re.match(r"\w+\s*:\s*\S+", s))
        or s.count("{") + s.count("}") >= 2 and cjk_share(s) < 0.3
        or plain and bool(re.search(r";\s*$", s)) and not s.endswith(";;") and bool(re.search(r"[=()]|\b(?:if|for|while|return|def|class)\b", s))
    )


# What ends a run of code, what stays in it, and what may stand before a line that does.
_LEAVES = re.compile(rf"^#{{2,6}}\s+|^[-*+]\s+|^\d+[.)]\s+|^\|(?:.*\|)?$|^```|^!\[.*\]\(.*\)|^\[[^\]]+\]\([^)]+\)|^[{_CJK}]{{2,}}")
_STAYS = re.compile(r"[(){}\"';=<>\[\]]|^#\s+|^//|^/\*")
_SQL_BEFORE = re.compile(r"\b(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)\b")


def continues(line: str, before: str | None) -> bool:
    """Does a run of code go on with this line? before: the line before, if it is in the run."""
    s = line.lstrip()
    if not s:
        return True
    if paired_marker(s) or _LEAVES.match(s) or bare_cjk(s):
        return False
    return bool(_STAYS.search(s)) or before is not None and bool(_SQL_BEFORE.search(before.upper()))


def unescape(s: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        s = s.replace(a, b)
    return s


def wrap_code(lines: list[str], flags: list[bool]) -> tuple[list[str], list[bool]]:
    """Puts fences around runs of code-like lines outside of fences and caption blocks; entities in code are decoded."""
    kinds, in_ocr, run = [], False, False
    for i, line in enumerate(lines):
        s = line.lstrip()
        in_ocr = in_ocr or not in_ocr and s == "*[Image OCR]*"
        if flags[i] or in_ocr:
            kinds.append("fenced" if flags[i] else "caption")
            run = False
        elif run and continues(line, lines[i - 1] if kinds[-1] == "code" else None):
            kinds.append("code")
        else:
            run = not _STARTS_CJK.match(s) and code_like(s) and not _SYNTAX.match(s) and (cjk_share(s) <= 0.4 or bool(re.search(r"[(){}\"';=<>\[\]|&]", s)))
            kinds.append("code" if run else "text")
        if in_ocr and s == "*[End OCR]*":
            in_ocr = False
    out, marks = [], []
    for i, (line, kind) in enumerate(zip(lines, kinds)):
        if kind == "code" and (not i or kinds[i - 1] != "code"):
            out.append("```")
            marks.append(False)
        out.append(unescape(line) if kind in ("code", "fenced") else line)
        marks.append(kind in ("code", "fenced"))
        if kind == "code" and (i + 1 == len(lines) or kinds[i + 1] != "code"):
            out.append("```")
            marks.append(False)
    return out, marks


def space_lists(lines: list[str], flags: list[bool]) -> tuple[list[str], list[bool]]:
    """A blank line before the first item of a list outside of code."""
    out, marks = [], []
    for line, code in zip(lines, flags):
        if not code and _LIST.match(line) and out and out[-1].strip() and not _LIST.match(out[-1]):
            out.append("")
            marks.append(False)
        out.append(line)
        marks.append(code)
    return out, marks


def clean(text: str, stem: str | None = None) -> str:
    """A Markdown text repaired: see the steps' own functions. stem: title to put in front where none of level one is."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\\_", "_")
    text = re.sub("-{3,}", "--", re.sub(" {3,}", "  ", text))
    lines = text.split("\n")
    lines, flags = wrap_code(lines, fence_flags(lines))
    lines, flags = space_lists([x.rstrip() for x in lines], flags)
    titled = any(re.match(r"# [^#]", x) and not f for x, f in zip(lines, flags))
    text = "\n".join(lines)
    if stem and not titled:
        text = f"# {stem}\n\n{text.lstrip()}"
    return re.sub("\n{3,}", "\n\n", text).strip() + "\n"


_RULE = re.compile(r"[\s|:-]*-[\s|:-]*")


def line_kinds(lines: list[str]) -> list[str]:
    """What a line is to a reader: code (fences too), blank, heading, rule (of a table), row, item or text."""
    out, fence = [], None
    for line in lines:
        m, s = re.match(r"^\s*(`{3,}|~{3,})", line), line.strip()
        if m or fence:
            out.append("code")
            if m and fence in (None, m[1][0]):
                fence = None if fence else m[1][0]
        elif s.startswith("|"):
            out.append("rule" if line.count("|") > 1 and all("-" in c for c in s.split("|") if c.strip()) and _RULE.fullmatch(s) else "row")
        else:
            out.append("heading" if s.startswith("#") else "item" if _LIST.match(line) else "text" if s else "blank")
    return out


def _marked_row(line: str, anchor: bool) -> str:
    row = "|"
    for cell in line.split("|")[1:-1]:
        text = cell.strip()
        row += f' <mark{" id=" + chr(34) + "first-hit" + chr(34) if anchor else ""}>{text}</mark> |' if text else " |"
        anchor = anchor and not text
    return row


def _marked_item(line: str, anchor: bool) -> str:
    mark, text = _LIST.match(line).groups()
    return f"{mark}=={text}==" + "<mark id='first-hit'/>" * anchor


def _marked_text(line: str, anchor: bool) -> str:
    return f"=={line}==" + ' <mark id="first-hit"/>' * anchor


_MARKED = {"row": _marked_row, "item": _marked_item, "text": _marked_text}


def highlight(text: str, hits: list[tuple[int, int]]) -> str:
    """Marks the lines of hit ranges [start, end): text and list items by ==, table cells by <mark>; code, blank lines, headings
    and rules of tables stay. The first mark gets the anchor first-hit, and a marked list a blank line before it."""
    lines = text.splitlines()
    out, anchor = [], True
    wanted = {i for a, b in hits for i in range(a, b)}
    for i, (line, kind) in enumerate(zip(lines, line_kinds(lines))):
        if i not in wanted or kind not in _MARKED:
            out.append(line)
            continue
        if kind == "item" and out and out[-1].strip() and not _LIST.match(out[-1]):
            out.append("")
        out.append(_MARKED[kind](line, anchor))
        anchor = anchor and kind == "row" and "<mark" not in out[-1]
    return "\n".join(out)


# ---------------------------------------------------------------- caption blocks

PLACEHOLDER = "[not recognisable]"


def caption_block(image_id: str, model: str, caption: str) -> list[str]:
    ok = caption.strip() and caption != PLACEHOLDER
    return ["*[Image OCR]*", f"id: {image_id}", f"model: {model}", f"status: {'ok' if ok else 'failed'}", "*", "", caption.strip(), "", "*[End OCR]*", ""]


def read_caption_block(lines: list[str], start: int) -> tuple[int, int, dict, list[str]] | None:
    """(first line, last line, header fields, body) of the caption block that follows from start, blank lines aside."""
    i = next((k for k in range(start, len(lines)) if lines[k].strip()), len(lines))
    if i == len(lines) or not _OCR_OPEN.match(lines[i].strip()):
        return None
    first, fields, i = i, {}, i + 1
    while i < len(lines) and lines[i].strip() != "*" and ":" in lines[i]:
        k, _, v = lines[i].strip().partition(":")
        fields[k.strip()] = v.strip()
        i += 1
    i += i < len(lines) and lines[i].strip() == "*"
    last = next((k for k in range(i, len(lines)) if _OCR_CLOSE.match(lines[k].strip())), None)
    return None if last is None else (first, last, fields, lines[i:last])
