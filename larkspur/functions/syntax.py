"""Where source code is best cut: at its declarations.

One scan of a file keeps a stack of open brackets and steps over strings, templates and
comments; declarations are looked for where a statement or a member can begin.  Those
that need a body or a value (functions, methods, aliases) count once it is met.

Defined cases: a null or unknown file name, and an empty or null text, give no points;
strings, comments and brackets left open end with the text.  Markup inside scripts is
read as code, so an apostrophe in it may hide the rest of its line.
"""

from __future__ import annotations

import re
from pathlib import PurePosixPath

# Fixed values. Languages by the ending of the file's name.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "tsx", ".mts": "typescript", ".cts": "typescript",
    ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".go": "go", ".rs": "rust",
}
# Fixed values. What a cut before each kind of declaration is worth.
WORTH = {
    "class": 100, "iface": 100, "struct": 100, "trait": 100, "impl": 100, "mod": 100, "export": 90,
    "func": 90, "method": 90, "decorated": 90, "type": 80, "enum": 80, "import": 60,
}

_NAME = r"[\w$]+"
_VIS = r"(?:pub(?:\s*\([^)\n]*\))?\s+)?"
#: Declarations by family: (pattern, kind, what has to follow at the same depth).
_SCRIPT = [
    (r"export\b", "export", ""),
    (rf"class\s+{_NAME}", "class", ""),
    (rf"(?:async\s+)?function\s+{_NAME}", "func", "{"),
    (r"import\b(?!\s*[(.])", "import", ""),
    (rf"(?:const|let)\s+(?!enum\b){_NAME}", "func", "=>"),
]
_TYPED = [
    *_SCRIPT,
    (rf"interface\s+{_NAME}", "iface", ""),
    (rf"type\s+{_NAME}\s*[<=]", "type", ""),
    (rf"(?:const\s+)?enum\s+{_NAME}", "enum", ""),
]
DECLARATIONS = {
    "javascript": _SCRIPT,
    "typescript": _TYPED,
    "tsx": _TYPED,
    "python": [
        (r"@", "decorated", ""),
        (r"class\b", "class", ""),
        (r"(?:async\s+)?def\b", "func", ""),
        (r"import\b", "import", ""),
        (r"from\s+(?!__future__\b)\S+\s+import\b", "import", ""),
    ],
    "go": [(r"type\b", "type", ""), (r"func\s*\([^)]*\)\s*\w+\s*\(", "method", ""), (r"func\s+\w", "func", ""), (r"import\b", "import", "")],
    "rust": [
        (_VIS + r"struct\s+\w", "struct", ""),
        (_VIS + r"enum\s+\w", "enum", ""),
        (_VIS + r"(?:unsafe\s+)?trait\s+\w", "trait", ""),
        (r"(?:unsafe\s+)?impl\b", "impl", ""),
        (_VIS + r"mod\s+\w", "mod", ""),
        (_VIS + r"use\b", "import", ""),
        (_VIS + r"type\s+\w", "type", "="),
        (_VIS + r'(?:(?:const|async|unsafe|extern(?:\s*"[^"\n]*")?)\s+)*fn\s+\w', "func", "{"),
    ],
}
_DECLARATIONS = {k: [(re.compile(p), kind, need) for p, kind, need in v] for k, v in DECLARATIONS.items()}
_METHOD = re.compile(
    r"(?:(?:public|private|protected|static|override|readonly|async|get|set)\s+)*\*?\s*"
    r"(?!(?:if|for|while|switch|catch|return|function|with|super|new|throw|typeof|await)\b)"
    r"(?:#?[\w$]+|\[[^\]\n]*\]|'[^'\n]*'|\"[^\"\n]*\")\s*\??\s*[(<]"
)


def _tokens(comments: str, strings: str, word: str = r"\w+") -> re.Pattern[str]:
    return re.compile(rf"(?P<skip>[^\S\n]+|{comments})|(?P<text>{strings})|(?P<word>{word})|(?P<line>\n)|(?P<mark>=>|[=!]==?|&&|\|\||\?\?|.)", re.S)


_QUOTES = r'"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*'"
_C = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_SCAN = {
    "python": _tokens(r"#[^\n]*|\\\n", r'[rRbBuUfF]{0,2}(?:"""(?:\\.|[^\\])*?(?:"""|\Z)|' + r"'''(?:\\.|[^\\])*?(?:'''|\Z)|" + _QUOTES + ")"),
    "go": _tokens(_C, r"`[^`]*(?:`|\Z)|" + _QUOTES),
    "rust": _tokens(r"//[^\n]*", r'b?r(?P<hash>#*)".*?(?:"(?P=hash)|\Z)|b?"(?:\\.|[^"\\])*(?:"|\Z)|' + r"b?'(?:\\u\{[^}\n]*\}|\\x..|\\.|[^\\'\n])'"),
}
_SCAN |= dict.fromkeys(("javascript", "typescript", "tsx"), _tokens(_C, _QUOTES, r"#?[\w$]+"))
_NESTED = re.compile(r"/\*|\*/")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(`|\$\{|\Z)", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
#: What a statement goes on after, over the end of a line; and where a brace opens a value or a type.
_GOES_ON = set("=+-*/%,&|?<.([:!~^") | {"=>", "==", "!=", "===", "!==", "&&", "||", "??"}
_VALUE = _GOES_ON - {"=>", "/"} | {"return", "default", "in", "of", "yield", "await", "extends", "export", "import", "keyof"}
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def language(path: str | None) -> str | None:
    return LANGUAGES.get(PurePosixPath(path).suffix.lower()) if path else None


def points(text: str | None, path: str | None) -> list[tuple[int, int]]:
    """(position, worth) of every declaration, the best per position, in order."""
    lang = language(path)
    if not text or lang is None:
        return []
    best: dict[int, int] = {}
    for at, kind in _scan(text, lang):
        best[at] = max(WORTH[kind], best.get(at, 0))
    return sorted(best.items())


def _scan(text: str, lang: str):
    script = lang in ("javascript", "typescript", "tsx")
    scan, declared = _SCAN[lang], _DECLARATIONS[lang]
    stack: list[str] = []  # open brackets: "(", "[", or what a brace holds
    start, last, before = True, "", ""  # may a statement begin; the last two tokens
    heading = ""  # what the next brace of this depth holds
    marked: tuple[int, int] | None = None  # first decorator before the statement, and its depth
    wait: tuple[int, str, str, int, int] | None = None  # position, kind, need, depth, step of a value
    case, after_mark, at, n = False, False, 0, len(text)
    while at < n:
        m = scan.match(text, at)
        kind, token, here = m.lastgroup, m.group(), at
        if lang == "rust" and token == "/" and text.startswith("/*", at):  # comments nest
            depth, at = 0, at
            for c in _NESTED.finditer(text, at):
                depth += 1 if c.group() == "/*" else -1
                if not depth:
                    break
            at = c.end() if not depth else n
            continue
        at = m.end()
        if kind == "skip":
            continue
        top = stack[-1] if stack else "block"
        if kind == "line":
            start = start or lang == "python" and not stack or lang != "python" and top not in ("(", "[") and last not in _GOES_ON
            continue
        if script and (token == "`" or token == "}" and top == "template"):
            if token == "}":
                stack.pop()
            t = _TEMPLATE.match(text, at)
            at = t.end()
            if t.group(1) == "${":
                stack.append("template")
            last, before, start = "`", last, False
            continue
        if script and token == "/" and last != "<" and (start or last in _GOES_ON or last in _VALUE) and (r := _REGEX.match(text, here)):
            at, last, before, start = r.end(), "`", last, False
            continue
        # an arrow function as the value of a declaration: a name or parameters, then the arrow
        if wait and wait[2] == "=>" and len(stack) == wait[3]:
            pos, what, need, depth, step = wait
            if step == 0:
                step = 1 if token == "=" else 0
            elif step == 1:
                if token == "function" and not re.match(r"\s*\*", text[at : at + 20]):
                    yield pos, what
                step = 1 if token == "async" else 2 if kind == "word" and token != "function" else 3 if token == "(" else 4 if token == "<" else 9
            elif token == "=>":
                yield pos, what
                step = 9
            elif step == 2 or step == 3 and token not in (")", ":"):
                step = 9
            elif token == ":":
                step = 4
            wait = None if step == 9 else (pos, what, need, depth, step)
        stays = False
        if start and top not in ("(", "[", "macro"):
            if script and top in ("class", "object"):
                if _METHOD.match(text, here):
                    wait = (here, "method", "{", len(stack), 0)
            elif top != "type":
                for pattern, what, need in declared:
                    if pattern.match(text, here):
                        pos = marked[0] if script and marked and what in ("class", "export") else here
                        if need:
                            wait = (pos, what, need, len(stack), 0)
                        elif not (what == "decorated" and marked):
                            wait = None
                            yield pos, what
                        break
                stays = script and (token in ("export", "declare") or token == "default" and last == "export")
            if token == "@":
                marked, after_mark = marked or (here, len(stack)), True
            elif not marked or len(stack) <= marked[1]:
                marked, after_mark = None, False
            case = token in ("case", "default") and not stays
        if wait and len(stack) == wait[3]:
            if token == wait[2] == "=" or token == wait[2] == "{" and not (script and last in _VALUE):
                yield wait[0], wait[1]
                wait, heading = None, "block"
            elif token == ";":
                wait = None
        if token in ("class", "interface", "enum") and script and last != ".":
            heading = "class" if token == "class" else "type"
        elif token == "macro_rules":
            heading = "macro"
        start = stays
        if token in _PAIRS:
            if token == "{":
                value = script and last in _VALUE and not (case and last == ":")
                macro = lang == "rust" and (top == "macro" or heading == "macro" or last == "!" and re.fullmatch(r"\w+", before))
                stack.append("macro" if macro else "{" if lang == "python" else "object" if value else heading or "block")
                heading, start = heading if value else "", lang != "python"
            else:
                stack.append("macro" if lang == "rust" and (top == "macro" or last == "!" and re.fullmatch(r"\w+", before)) else token)
                after_mark = after_mark or lang == "rust" and token == "[" and (last == "#" or last == "!" and before == "#")
        elif token in (")", "]", "}"):
            if stack:
                stack.pop()
            if wait and wait[3] > len(stack):
                wait = None
            start = token == "}" and lang != "python" and (stack[-1] if stack else "") not in ("(", "[", "template")
            if after_mark and token != "}" and (script or lang == "rust") and (stack[-1] if stack else "") not in ("(", "["):
                start = True
        elif token == ";" or token == ":" and lang == "python" and not stack or token == "," and top in ("class", "object"):
            start = True
        last, before = token if kind != "text" else '"', last
