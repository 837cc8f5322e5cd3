"""Paragraphs of DOCX and RTF files, from their bytes.

The bytes come from Spark's binary file source, so files can be in any store that Spark reads.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: RTF destinations without text of the document (fixed values).
_SILENT = frozenset("fonttbl colortbl stylesheet info pict header footer headerl headerr headerf footerl footerr footerf footnote listtable listoverridetable rsidtbl generator themedata datastore xmlnstbl latentstyles object field_inst fldinst bkmkstart bkmkend".split())
#: Control words that stand for a character (fixed values).
_SIGNS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}
_RTF = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.DOTALL)


def docx_text(raw: bytes) -> str:
    """The body's paragraphs, one on a line; tables, headers and footnotes aren't paragraphs of the body."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError, NotImplementedError, RuntimeError) as e:
        raise ValueError(f"no DOCX document: {e}") from e
    body = root.find(f"{_WORD}body")
    marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n", f"{_WORD}noBreakHyphen": "-"}

    def runs(p: ElementTree.Element) -> str:
        out = []
        for x in p:
            if x.tag in (f"{_WORD}r", f"{_WORD}hyperlink"):
                out.append(runs(x))
            elif x.tag == f"{_WORD}t":
                out.append(x.text or "")
            elif x.tag in marks:
                out.append(marks[x.tag])
        return "".join(out)

    return "\n".join(runs(p) for p in (body if body is not None else ()) if p.tag == f"{_WORD}p")


def rtf_text(raw: bytes) -> str:
    """The document's text: groups that hold fonts, styles, pictures or the like are left out."""
    body = raw.decode("latin-1")
    if not body.lstrip().startswith("{\\rtf"):
        raise ValueError("no RTF document")
    page = re.search(r"\\ansicpg(\d+)", body)
    code = f"cp{page[1]}" if page else "cp1252"
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    silent, width, skip = False, 1, 0  # whether the group has no text; characters that stand in for a \u; how many are left to skip
    for m in _RTF.finditer(body):
        word, number, byte, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append((silent, width))
            skip = 0
        elif brace == "}":
            silent, width = stack.pop() if stack else (False, 1)
            skip = 0
        elif sign == "*":
            silent = True
        elif word in _SILENT:
            silent = True
        elif word == "uc":
            width = int(number or 1)
        elif word == "bin":
            raise ValueError("RTF with binary data")
        elif silent:
            continue
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            skip = width
        elif byte or plain or sign in ("~", "_", "{", "}", "\\"):
            s = bytes.fromhex(byte).decode(code, "replace") if byte else {"~": "\u00a0", "_": "-"}.get(sign, sign) if sign else bytes(plain, "latin-1").decode(code, "replace")
            cut = min(skip, len(s))
            skip -= cut
            out.append(s[cut:])
        elif sign in ("\n", "\r"):
            out.append("\n")
        elif word in _SIGNS:
            out.append(_SIGNS[word])
    joined = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # pairs of \u numbers are one character
    return joined.strip("\n")
