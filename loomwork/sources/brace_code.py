"""Sources in JavaScript, TypeScript, Rust, Go, Java, C and C++ as the rows of ``python_code``: elements, calls, imports and bases.

A lexer turns a text into arrays of tokens, with the place of each bracket's partner; comments and strings end there. Definitions are known
by the tokens around their names, scopes by their brackets. It is no full grammar: code that macros or preprocessor branches
put together is read as it stands, and conversions or patterns that look like calls count as calls.
"""

import re

from loomwork.sources.elements import element_id

LANGUAGES = {
    **dict.fromkeys(("js", "mjs", "cjs", "jsx"), "js"), **dict.fromkeys(("ts", "mts", "cts", "tsx"), "ts"), "rs": "rust", "go": "go", "java": "java",
    "c": "c", **dict.fromkeys(("cpp", "cc", "cxx", "hpp", "hxx", "h"), "cpp"),
}
FAMILY = {"ts": "js", "cpp": "c"}
KEYWORDS = set("""if for while switch catch return sizeof typeof new delete throw await yield in of instanceof case do else function fn func match loop let const var static super this
  import export defer go select range chan map struct enum interface class assert synchronized alignof decltype static_assert where as move unsafe async pub use mod impl dyn ref mut void extends implements union with""".split())  # fmt: skip
MODIFIERS = set("public private protected static async get set readonly override abstract declare export default pub const unsafe extern final native inline virtual explicit accessor".split())

_NAME, _NUMBER, _OPERATOR = r"(?P<name>[^\W\d][\w$]*|\$[\w$]*|\#[^\W\d]\w*)", r"(?P<number>\d[\w.]*)", r"(?P<op>::|->|=>|[?][.]|\.\.\.?|&&|\|\||[=!<>]=|[^\s\w])"
_COMMENT, _DOUBLE = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))", r"\"(?:[^\"\\\n]|\\.)*\""
_STRINGS = {
    "js": rf"(?P<string>{_DOUBLE}|'(?:[^'\\\n]|\\.)*')",
    "rust": r"(?P<string>b?\"(?:[^\"\\]|\\.)*\"|[bc]?r(?P<hashes>#*)\".*?\"(?P=hashes)|b?'(?:[^'\\\n]|\\u\{[^}\n]*\}|\\x..|\\.)')|(?P<lifetime>'[^\W\d]\w*)",
    "go": rf"(?P<string>{_DOUBLE}|`[^`]*`|'(?:[^'\\\n]|\\.)+')",
    "java": rf"(?P<string>\"\"\".*?\"\"\"|{_DOUBLE}|'(?:[^'\\\n]|\\.)+')",
    "c": rf"(?P<string>R\"(?P<mark>[^()\\\s]*)\(.*?\)(?P=mark)\"|{_DOUBLE}|'(?:[^'\\\n]|\\.)+')|(?P<pre>^[ \t]*\#(?:\\\n|[^\n])*)",
}
_LEX = {k: re.compile(rf"(?P<space>\s+)|{_COMMENT}|{s}|{_NAME}|{_NUMBER}|{_OPERATOR if k == 'js' else _OPERATOR.replace('|[?][.]', '')}", re.DOTALL | re.MULTILINE) for k, s in _STRINGS.items()}
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.DOTALL)
_NESTED = re.compile(r"/\*|\*/")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


class Tokens:
    """kind, text, start and line of each token; partner: the place of a bracket's other end (the last token where it has none); before: the comments in front of a token."""

    def __init__(self, code, family):
        self.code, self.kind, self.text, self.start, self.before = code, [], [], [], {}
        self._read(family)
        self.partner, stack = list(range(len(self.text))), []
        for i, t in enumerate(self.text):
            if self.kind[i] == "op" and t in OPEN:
                stack.append(i)
            elif self.kind[i] == "op" and t in CLOSE:
                while stack and OPEN[self.text[stack[-1]]] != t:
                    self.partner[stack.pop()] = max(0, i - 1)
                if stack:
                    self.partner[i], self.partner[stack[-1]] = stack[-1], i
                    stack.pop()
        for i in stack:
            self.partner[i] = len(self.text) - 1
        self.line, at, n = [], 0, 1
        for s in self.start:
            n += code.count("\n", at, s)
            at = s
            self.line.append(n)

    def _add(self, kind, text, start):
        self.kind.append(kind)
        self.text.append(text)
        self.start.append(start)

    def _read(self, family):
        lex, code, i, held = _LEX[family], self.code, 0, []  # held: for each ${ of a template the braces that are open within it
        while i < len(code):
            if family == "js" and (code[i] == "`" or code[i] == "}" and held and held[-1] == 0):
                if code[i] == "}":
                    held.pop()
                end = _TEMPLATE.match(code, i + 1).end()
                self._add("string", code[i:end], i)
                i = end + 1
                if code.startswith("${", end):
                    held.append(0)
                    i = end + 2
                continue
            if family == "js" and code[i] == "/" and code[i : i + 2] not in ("//", "/*") and not self._operand() and (m := _REGEX.match(code, i)):
                self._add("string", m[0], i)
                i = m.end()
                continue
            m = lex.match(code, i)
            kind, end = m.lastgroup, m.end()
            if kind in ("hashes", "mark"):
                kind = "string"
            if kind == "comment":
                if family == "rust" and m[0].startswith("/*"):
                    depth, end = 0, i
                    while part := _NESTED.search(code, end):
                        depth, end = depth + (1 if part[0] == "/*" else -1), part.end()
                        if depth == 0:
                            break
                    end = end if depth == 0 else len(code)
                self.before.setdefault(len(self.text), []).append(code[i:end])
            elif kind != "space":
                if held and kind == "op" and m[0] in "{}":
                    held[-1] += 1 if m[0] == "{" else -1
                self._add(kind, m[0], i)
            i = end

    def _operand(self):
        """Whether a '/' divides what came last."""
        return bool(self.text) and (self.kind[-1] in ("number", "string") or self.text[-1] in (")", "]", "}") or self.kind[-1] == "name" and self.text[-1] not in KEYWORDS - {"this", "super"})

    def at(self, i):
        return self.text[i] if 0 <= i < len(self.text) else ""

    def named(self, i):
        return 0 <= i < len(self.text) and self.kind[i] == "name"

    def generic(self, i):
        """The place after ``<...>`` that begins at i, or i."""
        if self.at(i) != "<":
            return i
        depth, j = 0, i
        while j < len(self.text):
            t = self.text[j]
            if t in OPEN and self.kind[j] == "op":
                j = self.partner[j]
            depth += (t == "<") - (t == ">")
            if depth == 0:
                return j + 1
            if t in (";", "}"):
                return i
            j += 1
        return i

    def body(self, i, family):
        """The place of the '{' that opens the body of what is declared before i, or None if it ends without one; and its last token."""
        j = i
        while j < len(self.text):
            t = self.text[j]
            if t == "{":
                typed = self.at(j - 1) in ((":", "|", "&", "<") if family == "js" else ("interface", "struct") if family == "go" else ())
                if not typed:
                    return j, self.partner[j]
                j = self.partner[j]
            elif t in ("(", "["):
                j = self.partner[j]
            elif t in (";", "}", ")", "]", "=") and self.kind[j] == "op" or self.kind[j] == "pre":
                return None, j if t == ";" else j - 1
            j += 1
        return None, len(self.text) - 1

    def slice(self, i, j):
        """The source text of tokens i to j."""
        return self.code[self.start[i] : self.start[j] + len(self.text[j])] if i <= j else ""

    def receiver(self, dot):
        """The expression in front of a '.', '->' or '::'."""
        j = dot - 1
        while j >= 0:
            t = self.text[j]
            if t in ("?", "!") and self.kind[j] == "op":
                j -= 1
                continue
            if t in (")", "]"):
                j = self.partner[j]
                if self.at(j - 1) == "!" and self.named(j - 2):
                    j -= 2
                elif self.named(j - 1) and (self.text[j - 1] not in KEYWORDS - {"this", "super"} or self.at(j - 2) in (".", "?.", "::", "->")) or self.at(j - 1) in (")", "]"):
                    j -= 1
                    continue
            elif t == ">":
                depth = 0
                while j > 0:
                    depth += (self.text[j] == ">") - (self.text[j] == "<")
                    if depth == 0:
                        break
                    j -= 1
                if self.at(j - 1) == "::" or self.named(j - 1):
                    j -= 1 + (self.at(j - 1) == "::")
                    continue
            if self.at(j - 1) in (".", "?.", "::", "->"):
                j -= 2
                continue
            if self.at(j - 1) == "new":
                j -= 1
            break
        return self.slice(max(j, 0), dot - 1)


def _doc(t, first):
    """Comments right in front of a declaration, its modifiers and attributes: the last block, or the lines that end there."""
    while first and (t.at(first - 1) in MODIFIERS or t.at(first - 1) == "]" and t.at(t.partner[first - 1] - 1) == "#"):
        first = t.partner[first - 1] - 1 if t.at(first - 1) == "]" else first - 1
    found = t.before.get(first, [])
    if not found:
        return None
    if found[-1].startswith("/*"):
        text = re.sub(r"^/\*+|\*+/$", "", found[-1])
        return "\n".join(re.sub(r"^\s*\*+ ?", "", line).rstrip() for line in text.split("\n")).strip() or None
    lines = []
    for c in reversed(found):
        if c.startswith("/*"):
            break
        lines.append(re.sub(r"^//[/!]?\s?", "", c).rstrip())
    return "\n".join(reversed(lines)).strip() or None


def _types(t, lo, hi):
    """Names of a list of types: last segments, without type arguments and access words."""
    out, j, last = [], lo, None
    while j < hi:
        if t.text[j] == "<":
            j = max(t.generic(j), j + 1)
            continue
        if t.text[j] in ("(", "[", "{"):
            j = t.partner[j]
        elif t.text[j] == "," or t.text[j] in ("extends", "implements"):
            out.append(last)
            last = None
        elif t.named(j) and t.text[j] not in ("public", "private", "protected", "virtual", "final", "dyn", "mut"):
            last = t.text[j]
        j += 1
    return [x for x in [*out, last] if x]


def _first(t, i, stops):
    """The first token of the declaration that token i belongs to."""
    while i > 0 and t.at(i - 1) not in stops and t.kind[i - 1] != "pre":
        i = t.partner[i - 1] if t.at(i - 1) in (")", "]") else i - 1
    return i


def definitions(t, language):
    """(kind, name, first token, place of the name, '{' of the body or None, last token, bases) in order of their first tokens; and places of names that only declare."""
    family, out, declared, classes = FAMILY.get(language, language), [], set(), {}
    level = []  # brackets that are open: (last token, what they hold)
    spaces, listed = {}, -1  # '{' of namespaces and the like; the body after a list of initial values
    for i, word in enumerate(t.text):
        while level and i > level[-1][0]:
            level.pop()
        inside = level[-1][1] if level else "file"
        if t.kind[i] == "op" and word in OPEN:
            level.append((t.partner[i], "class" if i in classes else spaces.get(i, "block") if word == "{" else inside if inside == "class" and word != "(" else "block"))
        if t.kind[i] != "name" or i < listed:
            continue
        before, after = t.at(i - 1), t.at(i + 1)
        if family == "rust" and word == "fn" and t.named(i + 1):
            declared.add(i + 1)
            first = i
            while t.at(first - 1) in ("pub", "async", "const", "unsafe", "extern", "default") or t.at(first - 1).startswith('"') or t.at(first - 1) == ")" and t.at(t.partner[first - 1] - 1) == "pub":
                first = t.partner[first - 1] if t.at(first - 1) == ")" else first - 1
            b, last = t.body(t.generic(i + 2), family)
            if b is not None:
                out.append(("function", t.text[i + 1], first, i + 1, b, last, []))
        elif family == "rust" and word in ("struct", "enum") and t.named(i + 1):
            declared.add(i + 1)
            first = i - 1 if before == "pub" else t.partner[i - 1] - 1 if before == ")" and t.at(t.partner[i - 1] - 1) == "pub" else i
            b, last = t.body(t.generic(i + 2), family)
            if b is not None:
                spaces[b] = "fields"
            out.append((word, t.text[i + 1], first, i + 1, b, last, []))
        elif family == "rust" and word == "impl" and before in ("", ";", "}", "]", "{", "unsafe") and not (before == "{" and inside == "block"):
            j = t.generic(i + 1)
            b, last = t.body(j, family)
            if b is not None:
                end = next((k for k in range(j, b) if t.text[k] == "where"), b)
                split = next((k for k in range(j, end) if t.text[k] == "for" and t.at(k + 1) != "<"), None)
                classes[b] = True
                out.append(("class", t.slice(j if split is None else split + 1, end - 1), i - (before == "unsafe"), i, b, last, [] if split is None else _types(t, j, split)))
        elif family == "go" and word == "func" and (t.named(i + 1) or after == "(" and t.named(t.partner[i + 1] + 1) and t.at(t.partner[i + 1] + 2) in ("(", "[")) and inside == "file":
            k = i + 1 if t.named(i + 1) else t.partner[i + 1] + 1
            declared.add(k)
            b, last = t.body(k + 1, family)
            out.append(("function", t.text[k], i, k, b, last, []))
        elif family == "go" and word in ("interface", "struct") and after == "{":
            spaces[i + 1] = "fields"
        elif family in ("js", "java", "c") and word in ("class", "interface", "enum", "struct") and before not in (".", "?.", "@", "enum", "<", ",") and not (family == "js" and word == "struct"):
            k = i + 2 if after in ("class", "struct") else i + 1
            expression = family == "js" and word == "class" and before in ("=", "(", "return", ",", ":", "=>", "?")
            if not t.named(k) or t.text[k] in ("extends", "implements"):
                if expression:
                    spaces[t.body(k, family)[0] or -1] = "block"
                continue
            declared.add(k)
            j = t.generic(k + 1)
            head = t.at(j)
            if not (head in ("{", "extends", "implements", "permits", "final") or family == "c" and head == ":"):
                continue
            b, last = t.body(j, family)
            if b is None or expression:
                continue
            first = _first(t, i, (";", "{", "}", ":")) if family == "java" else i - 1 if before == "abstract" else i
            kind = {"enum": "enum", "struct": "struct", "interface": "interface"}.get(word, "class")
            classes[b] = True
            if word == "enum" and family != "java":
                classes.pop(b)
                spaces[b] = "fields"
            elif family == "js" and word == "interface":
                spaces[b] = classes.pop(b) and "fields"
            out.append((kind, t.text[k], first, k, b, last, _types(t, j + (head == ":"), b)))
        elif family == "c" and word in ("namespace", "extern"):
            j = i + 1
            while t.named(j) or t.at(j) == "::" or j < len(t.text) and t.kind[j] == "string":
                j += 1
            if t.at(j) == "{":
                spaces[j] = "file"
        elif family == "js" and word == "function" and t.named(i + 1) and after not in KEYWORDS:
            declared.add(i + 1)
            b, last = t.body(t.generic(i + 2), family)
            if b is not None and before not in ("=", "(", ",", ":", "return", "=>", "?", "new"):
                out.append(("function", t.text[i + 1], i - (before == "async"), i + 1, b, last, []))
        elif word not in KEYWORDS and t.at(t.generic(i + 1)) == "(" and family in ("js", "java", "c"):
            close = t.partner[t.generic(i + 1)]
            if family == "js":
                if before in ("{", "}", ";", ",", "*") or before in MODIFIERS or inside == "class" and before not in ("=", ".", "?.", "(", "=>", "new", "@"):
                    b = close + 1 if t.at(close + 1) == "{" else t.body(close + 1, family)[0] if t.at(close + 1) == ":" else None
                    if b is not None:
                        declared.add(i)
                        first = i
                        while t.at(first - 1) in MODIFIERS or t.at(first - 1) == "*":
                            first -= 1
                        out.append(("function", word, first, i, b, t.partner[b], []))
                    elif inside in ("class", "fields") and (before in ("{", "}", ";", ",", "*") or before in MODIFIERS):
                        declared.add(i)
            elif family == "java" and inside == "class":
                if before in ("=", "+", ".", "(", "->", "?", ":", "&&", "||", "!", "new", "return"):
                    continue
                declared.add(i)
                ends, tail = t.body(close + 1, family), t.at(close + 1)
                if before not in (",", "{", "}", ";", "@") and tail in ("{", "throws", ";", "default", "[") or before in ("}", ";", "{") and tail in ("{", "throws"):
                    out.append(("function", word, _first(t, i, (";", "{", "}")), i, *ends, []))
            elif family == "c" and inside in ("file", "class") and before not in ("=", ",", "(", "return"):
                declared.add(i)
                j = close + 1
                while t.at(j) in ("const", "noexcept", "override", "final", "volatile", "&", "&&", "try") or t.at(j) == "(" and t.at(j - 1) == "noexcept":
                    j = t.partner[j] + 1 if t.at(j) == "(" else j + 1
                b = t.body(j, family)[0] if t.at(j) in ("{", "->", ":") else None
                if b is not None and before != "~":
                    listed = b
                    declared |= {k for k in range(j, b) if t.at(k + 1) == "(" and t.at(k - 1) in (":", ",")}
                    out.append(("function", word, _first(t, i, (";", "{", "}", ":")), i, b, t.partner[b], []))
    return out, declared, classes, spaces


def imports(t, language):
    """(module, names, first token, last token)."""
    family, out, skip = FAMILY.get(language, language), [], set()
    quoted = lambda i: t.text[i].strip("'\"`")
    for i, word in enumerate(t.text):
        before = t.at(i - 1)
        if i in skip:
            continue
        if family == "js" and word == "import" and before not in (".", "?.") and t.kind[i] == "name" and t.at(i + 1) not in ("(", "."):
            j = i + 1
            while j < len(t.text) and t.kind[j] != "string" and t.text[j] != ";":
                j += 1
            if j < len(t.text) and t.kind[j] == "string":
                names, k = [], i + 1
                while k < j:
                    if t.text[k] == "*":
                        names.append("*")
                        k += 2
                    elif t.text[k] == "as":
                        k += 1
                    elif t.named(k) and not (t.text[k] in ("from", "type") and t.at(k + 1) not in (",", "}", "from", "as")):
                        names.append(t.text[k])
                    k += 1
                out.append((quoted(j), names, i, j))
        elif family == "js" and word == "require" and before != "." and t.at(i + 1) == "(":
            out += [(quoted(k), [], i, t.partner[i + 1]) for k in range(i + 2, t.partner[i + 1]) if t.kind[k] == "string" and t.at(k - 1) in ("(", ",") and t.at(k + 1) in (")", ",")]
        elif family == "rust" and word == "use" and before in ("", ";", "{", "}", "]", "pub", ")"):
            out.append((*_use(t, i + 1), i, next((k for k in range(i, len(t.text)) if t.text[k] == ";"), len(t.text) - 1)))
        elif family == "rust" and word == "mod" and t.named(i + 1) and t.at(i + 2) == ";":
            out.append((t.text[i + 1], [t.text[i + 1]], i, i + 2))
        elif family == "go" and word == "import" and before in ("", ";", ")") or family == "go" and word == "import" and t.kind[i - 1] in ("name", "string"):
            places = range(i + 2, t.partner[i + 1]) if t.at(i + 1) == "(" else range(i + 1, min(i + 3, len(t.text)))
            found = [k for k in places if t.kind[k] == "string"]
            out += [(quoted(k), [quoted(k).rsplit("/", 1)[-1]], k, k) for k in (found if t.at(i + 1) == "(" else found[:1])]
        elif family == "java" and word in ("import", "package") and before in ("", ";", "}") and t.kind[i] == "name":
            end = next((k for k in range(i, len(t.text)) if t.text[k] == ";"), len(t.text))
            module = "".join(t.text[k] for k in range(i + 1 + (t.at(i + 1) == "static"), end))
            out.append((module, [module.rsplit(".", 1)[-1]] if word == "import" else [], i, min(end, len(t.text) - 1)))
        elif family == "c" and t.kind[i] == "pre" and (m := re.match(r"\s*#\s*include\s*(?:<([^>\n]*)>|\"([^\"\n]*)\")", word)):
            module = m[1] or m[2] or ""
            out.append((module, [module], i, i))
    return out


def _use(t, i):
    """Path and names of a use declaration: every segment behind the first is a name too, and the plain entries of a list."""
    parts, names, j = [], [], i
    while j < len(t.text) and t.text[j] not in (";", "{"):
        if t.text[j] == "as":
            break
        if t.text[j] == "*":
            names.append("*")
        elif t.named(j):
            if parts:
                names.append(t.text[j])
            parts.append(t.text[j])
        j += 1
    if t.at(j) == "{":
        k, end, entry = j + 1, t.partner[j], []
        while k <= end:
            if t.text[k] in (",", "}") and k >= j:
                if entry and "{" not in entry and entry != ["self"]:
                    names.append("".join(entry[: entry.index("as")] if "as" in entry else entry))
                entry = []
            else:
                entry.append(t.text[k])
                if t.text[k] == "{":
                    k = t.partner[k]
            k += 1
    return "::".join(parts), names


def parse(path, code):
    """Rows of one file, as ``python_code.parse`` gives them; kinds struct, enum and interface come to those of Python. None for other extensions."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1]) if "." in path.rsplit("/", 1)[-1] else None
    if language is None:
        return None
    family, t = FAMILY.get(language, language), Tokens(code, FAMILY.get(language, language))
    rows = [(path, "file", element_id("file", path), path.rsplit("/", 1)[-1], None, 1, code.count("\n") + 1, None, None, None)]
    found, declared, classes, spaces = definitions(t, language)
    end_line = lambda i: t.line[i] + t.text[i].count("\n")
    owners, open_ = [rows[0][2]] * len(t.text), []
    for kind, name, first, _, body, last, bases in sorted(found, key=lambda d: (d[2], -d[5])):
        while open_ and first > open_[-1][0]:
            open_.pop()
        if kind == "function" and any(c for _, c in open_):
            kind = "method"
        owner = owners[first]
        own = element_id(kind, path, name, str(t.line[first]))
        rows.append((path, kind, own, name, owner, t.line[first], end_line(last), _doc(t, first), None, None))
        rows.extend((path, "base", own, b, None, t.line[first], t.line[first], None, None, None) for b in bases)
        owners[first : last + 1] = [own] * (last + 1 - first)
        open_.append((last, kind in ("class", "struct", "enum", "interface")))
    for module, names, first, last in imports(t, language):
        rows.append((path, "import", owners[first], module, None, t.line[first], end_line(last), None, names, 0))
    fields = {i for b, what in spaces.items() if what == "fields" for i in range(b, t.partner[b] + 1)}
    tags = set()
    if family == "rust":
        for i, w in enumerate(t.text):
            if w == "#" and t.at(i + 1 + (t.at(i + 1) == "!")) == "[":
                tags |= set(range(i, t.partner[i + 1 + (t.at(i + 1) == "!")] + 1))
    for i, word in enumerate(t.text):
        before = t.at(i - 1)
        dotted = before in (".", "?.", "->", "::")
        if t.kind[i] != "name" or t.at(i + 1) != "(" or i in declared or i in fields or i in tags or word in KEYWORDS and not dotted:
            continue
        if before in ("function", "fn", "func", "new", "@", "#") or family == "go" and before == "]":
            continue
        after = t.at(t.partner[i + 1] + 1)
        if family == "rust" and after in ("=>", "=") or family == "java" and before == "::":
            continue
        if dotted and family in ("java", "js") and _made(t, i - 1):
            continue
        rows.append((path, "call", owners[i], word, None, t.line[i], end_line(t.partner[i + 1]), t.receiver(i - 1) if dotted else None, None, None))
    return rows


def _made(t, dot):
    """Whether the dotted name that ends at a '.' is the type of a ``new``."""
    while t.at(dot) == "." and t.named(dot - 1):
        dot -= 2
    return t.at(dot) == "new"
