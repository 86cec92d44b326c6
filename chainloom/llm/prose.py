"""Running prose of an article in typesetting markup, by block.

One pass over the text replaces what is no prose: comments, formulas, listings,
tables, bibliographies, titles, headings, references and definitions vanish,
accents become letters, other commands go and leave their text. Blocks keep
their numbers: the parts between runs of blank lines, counted from 0, also where
something that vanishes holds blank lines.
"""

from __future__ import annotations

import re
import unicodedata

# Fixed values of the markup language.
_HIDDEN = (
    "equation|align|alignat|flalign|gather|multline|eqnarray|displaymath|math|tabular|tabularx|table|figure|array|verbatim|lstlisting|tikzpicture|algorithm|algorithmic|comment"
)
_WITH_ARGUMENT = (
    "title|author|date|thanks|affiliation|address|email|keywords|part|chapter|section|subsection|subsubsection|paragraph|subparagraph|label|ref|eqref|autoref|pageref|input|include|"
    "bibliography|bibliographystyle|usepackage|RequirePackage|documentclass|includegraphics|caption|url|hspace|vspace|setlength|pagestyle|thispagestyle|newtheorem|theoremstyle|selectlanguage"
)
_COMBINING = {"'": "\u0301", '"': "\u0308", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "k": "\u0328", "u": "\u0306", "r": "\u030a", "H": "\u030b", "d": "\u0323", "b": "\u0331"}
_LETTERS = {"ss": "ß", "ae": "æ", "oe": "œ", "AE": "Æ", "OE": "Œ", "aa": "å", "AA": "Å", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ"}

_ARG = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
_OPT = r"(?:\[[^\]]*\])*"
BLOCK_END = re.compile(r"\n[^\S\n]*\n\s*")
_BODY = re.compile(r"^[^%\n]*\\begin\{document\}", re.M)
_TOKEN = re.compile(
    rf"(?P<hidden>%[^\n]*"
    rf"|\\begin\{{thebibliography\}}(?s:.*?)(?:\\end\{{thebibliography\}}|\Z)"
    rf"|\\begin\{{(?P<env>{_HIDDEN})(?P<star>\*?)\}}(?s:.*?)\\end\{{(?P=env)(?P=star)\}}"
    rf"|\\iffalse(?![A-Za-z])(?s:.*?)\\fi(?![A-Za-z])"
    rf"|\\bibitem{_OPT}(?:\{{[^}}]*\}})?[^\n]*"
    rf"|\\(?:re|provide)?newcommand\*?\s*(?:\{{\s*\\[A-Za-z@]+\s*\}}|\\[A-Za-z@]+){_OPT}\s*{_ARG}"
    rf"|\\(?:DeclareMathOperator|newenvironment|renewenvironment)\*?\s*(?:{_ARG}\s*)+"
    rf"|\\[gex]?def\s*\\[A-Za-z@]+[^{{\n]*{_ARG}"
    rf"|\\[Cc]ite[A-Za-z]*\*?{_OPT}{_ARG}"
    rf"|\\(?:{_WITH_ARGUMENT})(?![A-Za-z])\*?{_OPT}(?:\s*{_ARG})?"
    rf"|\\(?:begin|end)\{{[^}}\n]*\}}{_OPT}"
    rf"|\$\$(?:[^$\\]|\\.)*\$\$"
    rf"|\$(?:[^$\\\n]|\\.|\\\n|\n(?![^\S\n]*\n))*\$"
    rf"|\\\[(?s:.*?)\\\]|\\\((?s:.*?)\\\))"
    rf"|\\(?P<mark>['\"`^~=.])\s*(?:\{{\s*\\?(?P<a>[^\W\d_])\s*\}}|\\?(?P<b>[^\W\d_])[ ]?(?<!\w[ ])|\\(?P<c>[ij])(?![A-Za-z])[ ]?)"
    rf"|\\(?P<tail>[cvkurHdb])(?:\s*\{{\s*(?P<d>[^\W\d_])\s*\}}|[ ]+(?P<e>[^\W\d_]))"
    rf"|\\(?P<letter>ss|ae|oe|AE|OE|aa|AA|o|O|l|L|i|j)(?![A-Za-z])(?:\{{\}}|[ ]+)?"
    rf"|\\(?P<plain>[%$&#_{{}}])"
    rf"|(?P<gone>\\[A-Za-z@]+\*?(?:\[[^\]\n]*\])?|\\.)"
    rf"|(?P<block>\n[^\S\n]*\n\s*)"
    rf"|(?P<brace>[{{}}])"
)


def _replace(m: re.Match) -> str:
    kind = m.lastgroup
    if kind == "hidden" or kind == "gone":
        text = m[0]
        return " " + "\0" * len(BLOCK_END.findall(text)) if "\n" in text else " "
    if kind == "block":
        return "\0"
    if kind == "brace":
        return ""
    if kind == "letter":
        return _LETTERS[m["letter"]]
    if kind == "plain":
        return m["plain"]
    mark = m["mark"] or m["tail"]
    letter = m["a"] or m["b"] or m["c"] or m["d"] or m["e"]
    return unicodedata.normalize("NFC", {"ı": "i"}.get(letter, letter) + _COMBINING[mark])


def blocks(text: str) -> str:
    """The prose of all blocks, joined by NUL characters: block k is part k of a split at NUL."""
    text = text.replace("\0", " ")
    lead = ""
    body = _BODY.search(text)
    if body:
        lead = "\0" * len(BLOCK_END.findall(text, 0, body.start()))
        until = text.find("\\end{document}", body.end())
        text = text[body.end() : until if until >= 0 else len(text)]
    out = _TOKEN.sub(_replace, text)
    return lead + (out if out.isascii() else unicodedata.normalize("NFC", out))
