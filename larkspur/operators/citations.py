"""Citation links in Markdown answers (RAG15-RAG17, STR14, FLT12): a small scanner that leaves code alone, run over Arrow batches.

Defined results: a null text stays null when it is normalised, cites nothing and shows nothing; records that repeat an id are used once, the first of them; an empty list of records cites nothing;
repeated rows are treated each; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

_FENCED = re.compile(r"(?ms)^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\Z)")
_INLINE = re.compile(r"(?s)(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)")
def code_spans(text: str) -> list[tuple[int, int]]:
    """Where code stands: fenced blocks, then inline code outside them."""
    spans = [m.span() for m in _FENCED.finditer(text)]
    masked = text
    for a, b in spans:
        masked = masked[:a] + "\x00" * (b - a) + masked[b:]
    return sorted([*spans, *(m.span() for m in _INLINE.finditer(masked))])


def _masked(text: str) -> str:
    """The text with code as blanks, in the simple form that rewriting knows: from three backticks to the next three, then from one to the next in its line. A fence that nothing closes, and one of tildes, is no code there."""
    out, at = [], 0
    while (i := text.find("```", at)) >= 0 and (j := text.find("```", i + 3)) >= 0:
        out += [text[at:i], " " * (j + 3 - i)]
        at = j + 3
    text = "".join([*out, text[at:]])
    out, at = [], 0
    while (i := text.find("`", at)) >= 0 and (j := text.find("`", i + 1)) >= 0:
        code = "\n" not in text[i:j]
        out += [text[at:i], " " * (j + 1 - i)] if code else [text[at : i + 1]]
        at = j + 1 if code else i + 1
    return "".join([*out, text[at:]])


def _is_id(label: str) -> bool:
    return label[:1] in tuple("123456789") and label.isdecimal()


def _name(label: str) -> str:
    """What labels are compared by."""
    return " ".join(label.split()).upper()


def _rewritten(text: str, change) -> str:
    """Brackets ``[label]`` that a target in brackets follows, each replaced by what change(label, mark, target, image) says. None: it is none of those looked for. What begins in code stays, up to its end."""
    masked, out, at = _masked(text), [], 0
    while (i := text.find("[", at)) >= 0:
        end = text.find("]", i)
        label = text[i + 1 : end] if end >= 0 else ""
        mark = text[end + 1 : end + 2] if end >= 0 else ""
        close = text.find(")" if mark == "(" else "]", end + 2) if mark in ("(", "[") and mark else -1
        new = None
        if label and "\n" not in label and close >= 0:
            new = change(label, mark, text[end + 2 : close], text[i - 1 : i] == "!")
        if new is None:
            out.append(text[at : i + 1])
            at = i + 1
        else:
            out += [text[at:i], text[i : close + 1] if masked[i] == " " else new]
            at = close + 1
    return "".join([*out, text[at:]])


def _without_definitions(text: str) -> str:
    """Definitions of numbers go, with the lines behind them that begin with a blank or tab. One that begins with a blank stays."""
    masked, kept, going, at = _masked(text), [], False, 0
    for line in re.findall(r"[^\n]*\n|[^\n]+$", text):
        bare = line.lstrip(" \t")
        if not (going and line[0] in " \t"):
            label, closed, _ = bare[1:].partition("]:")
            going = len(line) - len(bare) <= 3 and bare[:1] == "[" and bool(closed) and _is_id(label) and masked[at] != " "
            if not going:
                kept.append(line)
        at += len(line)
    return "".join(kept)


def normalise(text: str | None) -> str | None:
    """RAG15: every form of a citation link becomes ``[n]``; old links keep their label. Null stays null."""
    if text is None:
        return None
    now = _rewritten(text, lambda label, mark, target, _: f"[{label.strip()}]" if mark == "(" and target.startswith("citation:") and len(target) > 9 else None)
    now = _rewritten(now, lambda label, mark, target, image: f"[{label}]" if mark == "(" and not image and _is_id(label) and "\n" not in target else None)
    labels = _parsed(now)[1]

    def reference(label: str, mark: str, target: str, image: bool) -> str | None:
        if mark != "[" or image or not _is_id(label) or "\n" in target:
            return None
        return f"[{label}]" if _name(target.strip() or label) in labels else f"[{label}][{target}]"

    return _without_definitions(_rewritten(now, reference))


# Elements whose tags begin a block of HTML that goes on to a blank line.
_HTML_BLOCKS = frozenset(
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".split()
)
_TAG = re.compile(r"""<(?:/[A-Za-z][\w-]*\s*|[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?|!--.*?--|\?.*?\?|![A-Za-z][^>]*)>""", re.S)
_AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+)>")
_MARKER = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?: +|$)")


def _definition(text: str) -> tuple[str, str] | None:
    """(label, rest) if a paragraph begins with a link definition; its target may stand in the next line."""
    at = 1
    while at < len(text) and text[at] not in "[]":
        at += 2 if text[at] == "\\" else 1
    if text[:1] != "[" or text[at : at + 2] != "]:" or not text[1:at].strip():
        return None
    behind = re.match(r"[ \t]*\n?[ \t]*(<[^<>\n]*>|[^\s<]\S*)", text[at + 2 :])
    if not behind:
        return None
    rest = text[at + 2 + behind.end() :]
    title = re.match(r"""(?:[ \t]+|[ \t]*\n[ \t]*)(?:"[^"]*"|'[^']*'|\([^()]*\))[ \t]*(?:\n|$)""", rest)
    line = re.match(r"[ \t]*(?:\n|$)", rest)
    end = title or line
    return (_name(text[1:at]), rest[end.end() :]) if end else None


def _parsed(text: str) -> tuple[list[str], set[str]]:
    """(inline texts of the blocks, labels of link definitions): code blocks and blocks of HTML are left out. Quotes and lists are taken off line by line."""
    found: list[str] = []
    labels: set[str] = set()
    para: list[str] = []
    fence, html, inside, quotes = "", "", 0, 0

    def close() -> None:
        body = "\n".join(para)
        while made := _definition(body.lstrip(" ")):
            labels.add(made[0])
            body = made[1]
        if body.strip():
            found.append(body)
        para.clear()

    for line in text.split("\n"):
        line = line.expandtabs(4) if "\t" in line else line
        blank = not line.strip()
        if inside and (blank or line[:inside].strip() == ""):
            line = line[inside:]
        elif not para:
            inside = 0
        depth = 0
        while True:
            bare = line.lstrip(" ")
            if bare[:1] == ">" and len(line) - len(bare) < 4 and (not (fence or html) or depth < quotes):
                line, depth = bare[1:].removeprefix(" "), depth + 1
            elif fence or html:
                if depth == quotes:
                    break
                fence = html = ""  # its quote has ended
            elif (m := _MARKER.match(line)) and not re.fullmatch(r" {0,3}(?:[-*] *){3,}", line) and not (para and not line[m.end() :].strip()):
                close()
                inside += m.end() if m.end() - len(m[0].rstrip()) < 5 else len(m[0].rstrip()) + 1
                line = line[m.end() if m.end() - len(m[0].rstrip()) < 5 else len(m[0].rstrip()) + 1 :]
            else:
                break
        bare, indent = line.lstrip(" "), len(line) - len(line.lstrip(" "))
        if fence:
            if indent < 4 and len(run := bare.rstrip()) >= len(fence) and set(run) == {fence[0]}:
                fence = ""
        elif html:
            if (html == "\n" and not bare.strip()) or (html != "\n" and html in line.lower()):
                html = ""
        elif not bare.strip():
            close()
        elif indent >= 4 and not para:
            pass  # an indented code block
        elif indent < 4 and (m := re.match(r"`{3,}(?=[^`]*$)|~{3,}", bare)):
            close()
            fence, quotes = m[0], depth
        elif indent < 4 and bare[:1] == "<" and (html := _html_end(bare, bool(para))):
            close()
            quotes = depth
            if html != "\n" and html in line.lower()[2:]:
                html = ""
        elif indent < 4 and re.match(r"#{1,6}(?: |$)", bare):
            close()
            found.append(bare.lstrip("#"))
        elif indent < 4 and (re.fullmatch(r"(?:=+|-+) *", bare) and para or re.fullmatch(r"(?:[-_*] *){3,}", bare) and len(set(bare.replace(" ", ""))) == 1):
            close()
        else:
            para.append(bare)
    close()
    return found, labels


def _html_end(line: str, in_paragraph: bool) -> str:
    """What ends the block of HTML that a line begins: a text, a line end for a blank line, nothing if it begins none."""
    low = line.lower()
    if m := re.match(r"<(script|pre|style|textarea)(?=[\s>]|$)", low):
        return f"</{m[1]}>"
    for start, end in (("<!--", "-->"), ("<?", "?>"), ("<![cdata[", "]]>")):
        if low.startswith(start):
            return end
    if m := re.match(r"</?([a-z][a-z0-9]*)(?=[\s>]|/>|$)", low):
        if m[1] in _HTML_BLOCKS:
            return "\n"
    whole = _TAG.match(line)
    return "\n" if whole and not in_paragraph and not line[whole.end() :].strip() else ""


def _target(text: str, at: int, label: str, labels: set[str]) -> int:
    """Where a link ends whose bracket closes before ``at``; -1 if it is none."""
    if text[at : at + 1] == "(":
        m = re.compile(r"""\(\s*(?:<(?:[^<>\n\\]|\\.)*>|(?P<to>(?:[^\s()\\<]|\\.|\((?:[^\s()\\]|\\.)*\))(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)?)(?:\s+(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)""", re.S).match(text, at)
        if m:
            return m.end()
    if text[at : at + 1] == "[":
        end = text.find("]", at)
        if end >= 0 and "[" not in text[at + 1 : end]:
            return end + 1 if _name(text[at + 1 : end].strip() or label) in labels else -1
    return at if _name(label) in labels else -1


def _opaque(text: str) -> str:
    """Code, tags and bare links as zero characters; a backslash before one of their signs stands for itself."""
    out, i = [], 0
    while i < len(text):
        c, end = text[i], 0
        if c == "\\":
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == "`":
            run = len(text) - i - len(text[i:].lstrip("`"))
            m = re.compile(r"(?<!`)" + "`" * run + r"(?!`)").search(text, i + run)
            end = m.end() if m else 0
            if not m:
                out.append(text[i : i + run])
                i += run
                continue
        elif c == "<" and (m := _AUTOLINK.match(text, i) or _TAG.match(text, i)):
            end = m.end()
        out.append("\x00" * (end - i) if end else c)
        i = end or i + 1
    return "".join(out)


def _spoken(block: str, labels: set[str]) -> Iterator[str]:
    """The texts of a block in order: plain text between links, images, code and line ends; a link whose text is a number as ``[n]``."""
    text, out, openers = _opaque(block), [], []
    i = 0
    while i < len(text):
        c = text[i]
        if c == "\\" and text[i + 1 : i + 2] in tuple("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
            out.append(text[i + 1])
            i += 2
            continue
        if c == "[":
            openers.append([len(out), i, text[i - 1 : i] == "!" and (not out or out[-1] == "!"), True])
        elif c == "]" and openers:
            place, start, image, active = openers.pop()
            end = _target(text, i + 1, text[start + 1 : i], labels) if active else -1
            if end >= 0:
                inner = "".join(x for x in out[place + 1 :] if isinstance(x, str)).replace("\x00", "").strip("*_")
                del out[place - image :]
                out.append(("" if image or not inner.isdecimal() else f"[{inner}]",))
                if not image:
                    openers = [[*o[:3], o[3] and o[2]] for o in openers]  # no link inside a link
                i = end
                continue
        out.append(c)
        i += 1
    plain: list[str] = []
    for x in out:
        if isinstance(x, tuple) or x in "\n\x00":
            yield "".join(plain)
            plain = []
            if isinstance(x, tuple):
                yield x[0]
        else:
            plain.append(x)
    yield "".join(plain)


def cited(text: str | None, known: set[str]) -> list[str]:
    """RAG16: known ids in the order of the text, each once. Code of every kind, images, tags, bare links, definitions and links with other labels don't count; the label of a link that is a number does, and so does a bracket behind a backslash."""
    found: list[str] = []
    blocks, labels = _parsed(text or "")
    for block in blocks:
        for part in _spoken(block, labels):
            for label in re.findall(r"\[(\d+)\]", part):
                if _is_id(label) and label in known and label not in found:
                    found.append(label)
    return found


def visible(text: str | None) -> str:
    """STR14: what a reader sees of Markdown, white space collapsed. Code is kept as it is."""
    kept: list[str] = []

    def put(code: str) -> str:
        kept.append(code)
        return f"\x00{len(kept) - 1}\x00"

    text = text or ""
    out, at = [], 0
    for a, b in code_spans(text):
        body = text[a:b]
        inner = "\n".join(body.split("\n")[1:-1]) if _FENCED.match(body) else body.strip("`").strip()
        out += [text[at:a], put(inner)]
        at = b
    text = "".join([*out, text[at:]])
    text = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", text)
    text = re.sub(r"\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])", r"\1", text)
    lines = []
    for line in text.split("\n"):
        if re.fullmatch(r"\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*", line):
            continue
        line = re.sub(r"^\s*(?:#{1,6}\s+|(?:>\s?)+|[-*+]\s+|\d+[.)]\s+)", "", line)
        lines.append(" ".join(c.strip() for c in line.strip().strip("|").split("|")) if "|" in line else line)
    text = "\n".join(lines)
    for mark in (r"\*\*\*", r"\*\*", "__", "~~", r"\*", "_"):
        text = re.sub(rf"(?<!\w){mark}(?=\S)(.+?)(?<=\S){mark}(?!\w)", r"\1", text)
    return " ".join(re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], text).split())


def _normalised(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(normalise, na_action="ignore")


def _cited_ids(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, known in parts:
        yield pd.Series([cited(t, set() if k is None else set(k)) for t, k in zip(text, known, strict=True)])


def _visible(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(visible)


def normalised(text: Column) -> Column:
    return F.pandas_udf(_normalised, "string", PandasUDFType.SCALAR_ITER)(text)


def cited_ids(text: Column, known: Column) -> Column:
    return F.pandas_udf(_cited_ids, "array<string>", PandasUDFType.SCALAR_ITER)(text, known)


def visible_text(text: Column) -> Column:
    return F.pandas_udf(_visible, "string", PandasUDFType.SCALAR_ITER)(text)


def validated(answers: DataFrame, text: str = "content", records: str = "records") -> DataFrame:
    """RAG17, JN9: adds ``answer`` (normalised) and ``used`` (records in the order of their use)."""
    known = F.transform(records, lambda r: r["citationId"])
    made = answers.withColumn("answer", normalised(F.col(text))).withColumn("__ids", cited_ids(F.col("answer"), known))
    used = F.transform("__ids", lambda i: F.get(F.filter(F.col(records), lambda r: r["citationId"] == i), 0))
    return made.withColumn("used", used).drop("__ids")


def search_visible(messages: DataFrame, term: str, text: str = "content") -> DataFrame:
    """FLT12, AG22: messages whose visible text holds the term; a blank term keeps all."""
    shown = messages.withColumn("visible", visible_text(F.col(text)))
    return shown if not term.strip() else shown.where(F.contains(F.lower("visible"), F.lit(term.strip().lower())))
