"""Imports and symbols of source files by their tokens: statements over several lines, none in strings or comments, methods.

A file's text is cut into tokens by one pattern of its language, brackets are paired, and imports and declarations are
found at the tokens that begin them. Python is read by the interpreter's own grammar. A file that can't be read so
(brackets that don't pair, a comment without an end, another version's grammar) is left to the line patterns.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeterra.operators import parsing

ENGINE = "syntax"
SCRIPTS = ("javascript", "typescript", "tsx")
LANGUAGES = (*SCRIPTS, "python", "go", "rust")

_QUOTED = r'"(?:\\.|[^"\\\n])*"'
_MARKS = r"=>|->|::|\.\.\.|[=!<>]=+|&&|\|\||\?\?|\?\.|\S"
_TOKENS = {
    "script": re.compile(rf"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>{_QUOTED}|'(?:\\.|[^'\\\n])*')|(?P<word>\#?[\w$]+)|(?P<mark>/\*|{_MARKS})", re.S),
    "go": re.compile(rf"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>{_QUOTED}|`[^`]*`|'(?:\\.[^']*|[^'\\\n])')|(?P<word>\w+)|(?P<mark>/\*|{_MARKS})", re.S),
    "rust": re.compile(rf"""(?P<skip>\s+|//[^\n]*)|(?P<string>b?r(?P<hash>\#*)".*?"(?P=hash)|b?"(?:\\.|[^"\\])*"|b?'(?:\\.[^']*|[^'\\\n])')|(?P<word>'?\w+)|(?P<mark>/\*|{_MARKS})""", re.S),
}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(?:`|\$\{)", re.S)
_COMMENT = re.compile(r"/\*|\*/")
_CLOSES = {")": "(", "]": "[", "}": "{"}
_OPENS = {"(", "[", "{"}
# Words before an operand, words with a bracket and a block that name nothing, words that may stand before a member's name.
_OPERANDS = ("return", "typeof", "case", "in", "of", "new", "delete", "void", "throw", "do", "else", "yield", "await", "instanceof", "extends")
_CONTROLS = ("if", "for", "while", "switch", "catch", "with", "function")
_MODIFIERS = ("public", "private", "protected", "static", "readonly", "async", "get", "set", "override", "accessor", "*")


class Tokens:
    """A file's tokens: text, kind (word, string, mark), line, place in the source, partner of a bracket, and bracket around (-1: none)."""

    def __init__(self, source: str):
        self.source = source
        self.text: list[str] = []
        self.kind: list[str] = []
        self.line: list[int] = []
        self.begin: list[int] = []
        self.pair: dict[int, int] = {}
        self.around: list[int] = []

    def at(self, k: int) -> str:
        """The text of a word or mark; nothing for a string or beyond the file."""
        return self.text[k] if 0 <= k < len(self.text) and self.kind[k] != "string" else ""

    def is_a(self, kind: str, k: int) -> bool:
        return 0 <= k < len(self.text) and self.kind[k] == kind

    def leads(self, k: int) -> bool:
        """Whether a token is its line's first."""
        return k == 0 or self.line[k - 1] < self.line[k]

    def over(self, k: int) -> int:
        """The place after k, or after the brackets that k opens."""
        return self.pair.get(k, k) + 1 if self.at(k) in _OPENS else k + 1

    def until(self, k: int, marks: tuple[str, ...]) -> int:
        """The first of marks from k on with the same bracket around, or what closes that."""
        while k < len(self.text) and self.at(k) not in marks and self.at(k) not in _CLOSES:
            k = self.over(k)
        return k

    def after_angles(self, k: int) -> int:
        """The place after the <...> that k opens, if it does."""
        depth = 0
        while self.at(k) and (depth or self.at(k) == "<"):
            depth += {"<": 1, ">": -1}.get(self.at(k), 0)
            k = self.over(k)
            if not depth:
                break
        return k


def tokens_of(source: str, family: str) -> Tokens | None:
    """None where brackets don't pair or a comment or template has no end."""
    out, at, line = Tokens(source), 0, 1
    open_: list[int] = []
    templates: list[int] = []  # how many brackets are open around each template that goes on after a }

    def add(text: str, kind: str, place: int) -> None:
        out.text.append(text)
        out.kind.append(kind)
        out.line.append(line)
        out.begin.append(place)
        out.around.append(open_[-1] if open_ else -1)
        if kind == "mark" and text in _OPENS:
            open_.append(len(out.text) - 1)

    def close(text: str, place: int) -> bool:
        if not open_ or out.text[open_[-1]] != _CLOSES[text]:
            return False
        start = open_.pop()
        add(text, "mark", place)
        out.pair[start], out.pair[len(out.text) - 1] = len(out.text) - 1, start
        return True

    while at < len(source):
        c = source[at]
        if family == "script" and (c == "`" or c == "}" and templates and templates[-1] == len(open_)):
            part = _TEMPLATE.match(source, at + 1)
            if not part or c == "}" and not close("}", at):
                return None
            if c == "}":
                templates.pop()
            add(source[at : part.end()], "string", at)
            line += source.count("\n", at, part.end())
            at = part.end()
            if source[at - 1] == "{":
                add("{", "mark", at - 1)
                templates.append(len(open_))
            continue
        if family == "script" and c == "/":
            last, kind = (out.text[-1], out.kind[-1]) if out.text else ("", "mark")
            if last in _OPERANDS or kind == "mark" and last not in (")", "]", "}", "<"):
                literal = _REGEX.match(source, at)
                if literal:
                    add(literal[0], "string", at)
                    at = literal.end()
                    continue
        found = _TOKENS[family].match(source, at)
        kind, text = found.lastgroup, found[0]
        if text == "/*":
            depth, end = 1, at + 2
            while depth and (mark := _COMMENT.search(source, end)):
                depth += 1 if mark[0] == "/*" else -1
                end = mark.end()
            if depth:
                return None
            kind, text = "skip", source[at:end]
        if kind == "mark" and text in _CLOSES:
            if not close(text, at):
                return None
        elif kind != "skip":
            add(text, kind, at)
        line += text.count("\n")
        at += len(text)
    return None if open_ or templates else out


class Structure(list):
    """What is found: (what, line, name, kind)."""

    def imported(self, line: int, name: str, kind: str) -> None:
        self.append(("import", line, name, kind))

    def declared(self, line: int, name: str, kind: str) -> None:
        self.append(("symbol", line, name, kind))


def _has_body(t: Tokens, k: int) -> bool:
    """Whether the parameters that k opens are followed by a block, with a type before it or not."""
    k = t.over(k)
    if t.at(k) == ":":
        k += 1
        while k < len(t.text):
            if t.at(k) == "{" and t.at(k - 1) not in (":", "|", "&", "<", ",", "=>", "is", "extends", "?"):
                return True
            if t.at(k) in (";", ",", "=", *_CLOSES) or t.at(k) != "{" and t.leads(k) and (t.kind[k - 1] == "word" or t.at(k - 1) in _CLOSES or t.at(k - 1) == ">"):
                return False
            k = t.over(k)
    return t.at(k) == "{"


def _begins(t: Tokens, k: int) -> bool:
    """Whether a statement begins at k."""
    last = t.at(k - 1)
    return k == 0 or last in (";", "{", "}", "export", "default", "declare") or last == ")" and _after_decorator(t, k) < k or t.leads(k) and (t.kind[k - 1] != "mark" or last in (")", "]", ">"))


def _after_decorator(t: Tokens, k: int) -> int:
    """Where the decorators before k begin; k itself where there are none."""
    while True:
        j = k - 1
        if t.at(j) == ")":
            j = t.pair[j] - 1
        while t.is_a("word", j) and t.at(j - 1) == ".":
            j -= 2
        if not (t.is_a("word", j) and t.at(j - 1) == "@"):
            return k
        k = j - 1


def _is_function(t: Tokens, k: int) -> bool:
    """Whether the expression at k is a function or an arrow with its parameters."""
    if t.at(k) == "async" and not t.leads(k + 1) and t.at(k + 1) != "=>":
        k += 1
    if t.at(k) == "function":
        return t.at(k + 1) != "*"
    k = t.after_angles(k)
    if t.is_a("word", k):
        return t.at(k + 1) == "=>"
    if t.at(k) != "(":
        return False
    k = t.over(k)
    return t.at(k) == "=>" or t.at(k) == ":" and t.at(t.until(k + 1, ("=>", ";", "=", ","))) == "=>"


def _script(t: Tokens) -> Structure:
    found, classes, typed = Structure(), set(), set()
    for k, (text, kind) in enumerate(zip(t.text, t.kind)):
        around = t.around[k]
        if kind == "word" and t.at(k - 1) not in (".", "?."):
            if text in ("require", "import") and t.at(k + 1) == "(" and k not in typed and t.is_a("string", k + 2):
                end = t.until(k + 2, (",",))
                first, last = t.text[k + 2], t.text[end - 1]
                if end == k + 3 and first[0] != "/" or first[0] == "`" == last[-1] and t.is_a("string", end - 1):
                    whole = t.source[t.begin[k + 2] : t.begin[end - 1]] + last
                    found.imported(t.line[k], whole[1:-1], text)
            elif text in ("import", "export") and _begins(t, k):
                j = k + 1
                if not (text == "import" and t.is_a("string", j)):
                    while t.is_a("word", j) and t.at(j) not in ("from", "function", "class", "const", "let", "var", "default") or t.at(j) in ("{", "*", ","):
                        j = t.over(j)
                    if text == "import" and t.at(j) == "=":
                        typed.add(j + 1)
                    if t.at(j) == "from" and not t.is_a("string", j + 1):
                        j = t.over(j)  # a name like any other
                        while t.is_a("word", j) and t.at(j) != "from" or t.at(j) in ("{", "*", ","):
                            j = t.over(j)
                    j = j + 1 if t.at(j) == "from" else len(t.text)
                if t.is_a("string", j):
                    found.imported(t.line[k], t.text[j][1:-1], "from")
            elif text == "function":
                begin = k - 1 if t.at(k - 1) == "async" else k
                name = k + 2 if t.at(k + 1) == "*" else k + 1
                if t.is_a("word", name) and _begins(t, begin) and _has_body(t, t.after_angles(name + 1)):
                    found.declared(t.line[begin], t.text[name], "function")
            elif text == "class" and t.at(k + 1) != ":":
                begin = _after_decorator(t, k)
                named = t.is_a("word", k + 1) and t.at(k + 1) not in ("extends", "implements")
                head = t.after_angles(k + 2) if named else k + 1
                while head < len(t.text) and not (t.at(head) == "{" and t.at(head - 1) not in ("<", ",", "(", "|", "&", ":", "=")):
                    head = t.over(head)
                classes.add(head)
                if named and t.at(begin - 1) != "abstract" and _begins(t, begin):
                    found.declared(t.line[begin], t.text[k + 1], "class")
            elif text in ("interface", "type") and t.is_a("word", k + 1) and _begins(t, k):
                after = t.at(t.after_angles(k + 2))
                if text == "interface" and after in ("{", "extends") or text == "type" and after == "=":
                    found.declared(t.line[k], t.text[k + 1], text)
            elif text in ("const", "let", "var") and t.at(k + 1) not in (":", "=", "(", ",", ")"):
                j = k + 1
                while j < len(t.text):
                    value = t.until(j, ("=", ",", ";"))
                    if t.at(value) == "=" and t.is_a("word", j) and _is_function(t, value + 1):
                        found.declared(t.line[j], t.text[j], "function")
                    # the next name stands after a comma; a line that begins with a word after an operand is another statement
                    j = value
                    while j < len(t.text) and t.at(j) not in (",", ";", *_CLOSES) and not (j > value + 1 and t.leads(j) and t.is_a("word", j) and (t.kind[j - 1] != "mark" or t.at(j - 1) in _CLOSES)):
                        j = t.over(j)
                    if t.at(j) != ",":
                        break
                    j += 1
        name = t.pair[k] if text == "]" and kind == "mark" else k
        if around >= 0 and t.text[around] == "{" and (kind != "mark" or text == "]") and text not in _CONTROLS:
            begin = name
            while t.at(begin - 1) in _MODIFIERS and begin - 1 > around:
                begin -= 1
            last = t.at(begin - 1)
            fits = last in ("{", ";", "}", ")") or t.leads(begin) and t.kind[begin - 1] != "mark" or last == "]" and t.leads(begin) if around in classes else last in ("{", ",")
            opens = t.after_angles(k + 2 if t.at(k + 1) == "?" else k + 1)
            if fits and t.at(opens) == "(" and _has_body(t, opens):
                found.declared(t.line[begin], t.source[t.begin[name] : t.begin[k] + len(text)], "method")
    return found


def _go(t: Tokens) -> Structure:
    found = Structure()
    for k, text in enumerate(t.text):
        if t.kind[k] != "word" or not (t.leads(k) or t.at(k - 1) == ";"):
            continue
        if text == "import" and t.around[k] < 0:
            ends = t.pair[k + 1] if t.at(k + 1) == "(" else k + 3
            for j in range(k + 1, min(ends, len(t.text))):
                if t.is_a("string", j):
                    found.imported(t.line[j], t.text[j][1:-1], "import")
                    if t.at(k + 1) != "(":
                        break
        elif text == "func" and t.around[k] < 0:
            name = t.over(k + 1) if t.at(k + 1) == "(" else k + 1
            if t.is_a("word", name) and t.at(name + 1) in ("(", "["):
                found.declared(t.line[k], t.text[name], "method" if name > k + 1 else "function")
        elif text == "type":
            opens = t.at(k + 1) == "("
            for j in range(k + 2, t.pair[k + 1]) if opens else (k + 1,):
                own = t.around[j] == k + 1 and (t.leads(j) or t.at(j - 1) in ("(", ";")) and t.at(j - 1) not in ("|", ",", ".") if opens else True
                if own and t.is_a("word", j) and t.at(j + 1) not in ("=", ""):
                    found.declared(t.line[j], t.text[j], "type")
    return found


def _rust(t: Tokens) -> Structure:
    found = Structure()
    for k, text in enumerate(t.text):
        if text not in ("use", "fn", "struct", "enum") or t.kind[k] != "word":
            continue
        begin = k
        while t.at(begin - 1) in ("pub", "async", "unsafe", "const", "extern", "default") or t.is_a("string", begin - 1) and t.at(begin - 2) == "extern" or t.at(begin - 1) == ")" and t.at(t.pair[begin - 1] - 1) == "pub":
            begin = t.pair[begin - 1] - 1 if t.at(begin - 1) == ")" else begin - 1
        if not (t.leads(begin) or t.at(begin - 1) in (";", "{", "}", "]")):
            continue
        end = t.until(k + 1, (";", "{"))
        if text == "use":
            end = t.until(k + 1, (";",))
            if t.at(end) == ";":
                found.imported(t.line[begin], t.source[t.begin[k + 1] : t.begin[end]].strip(), "use")
        elif t.is_a("word", k + 1) and (text != "fn" or t.at(end) == "{"):
            found.declared(t.line[begin], t.text[k + 1], "function" if text == "fn" else "type")
    return found


def _python(source: str) -> Structure | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    nodes, left = [], [tree]
    while left:
        node = left.pop()
        left += ast.iter_child_nodes(node)
        if isinstance(node, (ast.Import, ast.ImportFrom, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            nodes.append(node)
    found = Structure()
    for node in sorted(nodes, key=lambda n: (n.lineno, n.col_offset)):
        if isinstance(node, ast.Import):
            found.imported(node.lineno, node.names[0].name, "import")
        elif isinstance(node, ast.ImportFrom):
            if node.module != "__future__":
                found.imported(node.lineno, "." * node.level + (node.module or ""), "from")
        else:
            found.declared(node.lineno, node.name, "class" if isinstance(node, ast.ClassDef) else "function")
    return found


def structure_of(source: str, language: str) -> Structure | None:
    """Imports and symbols in the order of their tokens; None where the file can't be read so."""
    if language == "python":
        return _python(source)
    read = {"go": _go, "rust": _rust}.get(language, _script)
    found = tokens_of(source, language if language in ("go", "rust") else "script")
    return None if found is None else read(found)


_READ = "path string, language string, text string, engine string, found array<struct<what:string,line:bigint,name:string,kind:string>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("what", pa.string()), ("line", pa.int64()), ("name", pa.string()), ("kind", pa.string())])
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            path, language, text = (batch.column(k).slice(at, 64) for k in range(3))
            made = [None if x is None else structure_of(x, y) for x, y in zip(text.to_pylist(), language.to_pylist())]
            rows = [None if m is None else [dict(zip(("what", "line", "name", "kind"), x)) for x in m] for m in made]
            left = [t if m is None else None for t, m in zip(text.to_pylist(), made)]
            engine = [None if m is None else ENGINE for m in made]
            yield pa.record_batch([path, language, pa.array(left, pa.string()), pa.array(engine, pa.string()), pa.array(rows, pa.list_(item))], names=["path", "language", "text", "engine", "found"])


def read(files: DataFrame) -> DataFrame:
    """files(path, language, text) -> (path, language, text, engine, found): of files that are read by tokens what is in them, of the others the text, left to the line patterns."""
    some = F.col("language").isin(*LANGUAGES)
    rest = files.where(~some).select("path", "language", "text", F.lit(None).cast("string").alias("engine"), F.lit(None).cast(_READ.rsplit(" ", 1)[1]).alias("found"))
    return files.where(some).select("path", "language", "text").mapInArrow(_read, _READ).union(rest)


def imports(found: DataFrame) -> DataFrame:
    """read() -> (path, language, line, specifier, kind), by either engine."""
    own = found.where("engine is not null").select("path", "language", F.explode("found").alias("x")).where("x.what = 'import'")
    return own.select("path", "language", "x.line", F.col("x.name").alias("specifier"), "x.kind").unionByName(parsing.imports(parsing.lines_of(found.where("engine is null"))))


def symbols(found: DataFrame, most: int = parsing.MOST_SYMBOLS) -> DataFrame:
    """read() -> (path, line, name, kind): the first `most` symbols of each file, in order, by either engine."""
    first = F.slice(F.filter("found", lambda x: x["what"] == "symbol"), 1, most)
    own = found.where("engine is not null").select("path", F.explode(first).alias("x")).select("path", "x.line", "x.name", "x.kind")
    return own.unionByName(parsing.symbols(parsing.lines_of(found.where("engine is null")), most))


def engines(found: DataFrame) -> DataFrame:
    """read() of parsed files -> (path, engine)."""
    return found.select("path", F.coalesce("engine", parsing.engine_of(F.col("language"), F.lit(True))).alias("engine")).where("engine is not null")
