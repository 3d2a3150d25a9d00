"""Plain versions of sections, blocks, splits and merges, one text at a time, for small inputs."""

import re


def sections(text):
    out, stack, body, start = [], {}, [], 0

    def close():
        if "".join(body).strip():
            out.append(("/" + "".join(stack[k] + "/" for k in sorted(stack)), start, "\n".join(body)))

    for i, line in enumerate(text.splitlines()):
        m = re.match(r"^(#+)[ \t]+(.*)$", line)
        if m and len(m[1]) <= 6:
            close()
            for k in [k for k in stack if k >= len(m[1])]:
                del stack[k]
            stack[len(m[1])] = m[2].strip()
            body, start = [], i + 1
        else:
            body.append(line)
    close()
    return out


def blocks(body, first):
    """(type, text, start, end, language, fence) with absolute lines."""
    lines, out, i = body.split("\n"), [], 0
    kind = lambda x: "ocr" if re.match(r"^\*\[Image OCR\]\*\s*$", x) else "code" if re.match(r"^[ \t]{0,3}(```|~~~)", x) else "math" if x.strip() == "$$" else "table" if re.match(r"^\s*\|.*\|\s*$", x) else "text"
    while i < len(lines):
        if lines[i].strip() == "":
            i += 1
            continue
        k, j, language, fence = kind(lines[i]), i + 1, None, None
        if k == "table" or k == "text":
            while j < len(lines) and kind(lines[j]) == k:
                j += 1
            text = "\n".join(lines[i:j])
        elif k == "code":
            fence, language = re.match(r"^\s*(`+|~+)\s*([^\s`]*)", lines[i]).groups()
            while j < len(lines) and not ((m := re.match(r"^[ \t]{0,3}(`{3,}|~{3,})", lines[j])) and m[1][0] == fence[0] and len(m[1]) >= len(fence)):
                j += 1
            text = "\n".join(lines[i + 1:j])
            j = min(j + 1, len(lines))
        else:
            end = (lambda x: x.strip() == "$$") if k == "math" else (lambda x: re.match(r"^\*\[End OCR\]\*\s*$", x))
            while j < len(lines) and not end(lines[j]):
                j += 1
            j = min(j + 1, len(lines))
            text = "\n".join(lines[i:j])
        out.append((k, text, first + i, first + j, language or None, fence))
        i = j
    return out


def pack(lines, most):
    groups = []
    for i, line in enumerate(lines):
        if groups and len("\n".join(lines[groups[-1][0]:i] + [line])) <= most:
            groups[-1][1] = i + 1
        else:
            groups.append([i, i + 1])
    return groups


def pieces(block, size):
    """(text, start, end) of what a block becomes."""
    k, text, start, end, language, fence = block
    lines = text.split("\n")
    if k == "text":
        return [("\n".join(lines[a:b]), start + a, start + b) for a, b in pack(lines, size) if "".join(lines[a:b]).strip()]
    if k == "table":
        at = [i for i, x in enumerate(lines) if "|" in x and "-" in x]
        if len(lines) < 3 or not at or at[0] == 0 or at[0] == len(lines) - 1:
            return [(text, start, end)]
        head, rows = lines[:at[0] + 1], lines[at[0] + 1:]
        room = size + 300 - len("\n".join(head))
        out, a = [], 0
        while a < len(rows):
            b = a + 1
            while b < len(rows) and sum(len(r) + 1 for r in rows[a:b + 1]) <= room:
                b += 1
            out.append(("\n".join([f"【表格 第 {a + 1}-{b} 行，共 {len(rows)} 行】", "", *head, *rows[a:b]]), start + len(head) + a, start + len(head) + b))
            a = b
        return out
    if k == "code" and text.strip():
        mark = fence[0] * max(3, len(fence))
        shut = lambda body: f"{mark}{language or ''}\n{body}\n{mark}"
        if len(text) <= 1.5 * size:
            return [(shut(text.rstrip("\n")), start, end)]
        out, a = [], 0
        while a < len(lines):
            b = a + 1
            while b < len(lines) and sum(len(x) + 1 for x in lines[a:b + 1]) <= size:
                b += 1
            body = "\n".join(lines[a:b]).rstrip("\n")
            out.append((f"【代码块 第 {a + 1}-{b} 行，共 {len(lines)} 行】\n" + shut(body), start + 1 + a, start + 1 + b))
            a = b
        return out
    return [(text, start, end)]


def chunks(text, size):
    """(path, start, end, types, merged, text) of a document."""
    todo = []
    for path, first, body in sections(text):
        for block in blocks(body, first):
            parts = [(block[0], *p) for p in pieces(block, size)] if block[0] == "text" else [(block[0], block[1], block[2], block[3])]
            for k, t, a, b in parts:
                if t.strip().startswith("#") and "\n" not in t.strip():
                    continue
                for u, c, d in [(t, a, b)] if k == "text" else pieces(block, size):
                    todo.append((path, c, d, k, "[SECTION]\n" + " > ".join(x for x in path.split("/") if x) + "\n\n[CONTENT]\n" + u))
    return merge(todo, size)


def merge(todo, size):
    above = lambda p: p.rstrip("/").rpartition("/")[0] + "/" if p.count("/") > 2 else "/"
    out = []
    while todo:
        group = [todo.pop(0)]
        if len(group[0][4]) < 0.75 * size:
            have = len(group[0][4])
            while todo and have < 1.5 * size:
                near = above(todo[0][0]) == above(group[0][0]) or todo[0][0].startswith(group[0][0])
                if not near or have + 2 + len(todo[0][4]) > 1.5 * size:
                    break
                have += 2 + len(todo[0][4])
                group.append(todo.pop(0))
        out.append((group[0][0], group[0][1], group[-1][2], "|".join(sorted({g[3] for g in group})), len(group) if len(group) > 1 else None, "\n\n".join(g[4] for g in group).strip()))
    return out
