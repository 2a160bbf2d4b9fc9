"""Scripts, scenes and project files as nested rows: symbols, dependencies, references, doc comments, attachments.

Lexing is stateful, so this is plain Python that `parsed` runs inside Arrow batches; nothing here raises on malformed input.
A script is one pass of a token pattern and one pass over its lines; both languages share tokens and differ in their rules.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Limits(NamedTuple):
    lines: int
    size: int
    tokens: int
    dependencies: int


#: Limits of the two script tiers and of scenes.
TIERS = {"header": Limits(240, 64 << 10, 16 << 10, 2 << 10), "full": Limits(250 << 10, 8 << 20, 512 << 10, 32 << 10)}
SCENE_LIMITS = Limits(64 << 10, 8 << 20, 0, 0)
#: Types that are no classes of a project.
PRIMITIVES = set(
    """void bool boolean int int32 int64 float double decimal short ushort byte sbyte uint uint32 long ulong string stringname char
    var variant object nint nuint array dictionary nodepath callable signal""".split()
)
#: Words of C# that stand between an export attribute and its type.
MODIFIERS = set("public private protected internal static readonly const partial virtual override new".split())
#: The engine's own types that make a class a node or a resource.
NODE_TYPES = set(
    """Node Node2D Node3D Control CanvasItem CharacterBody2D CharacterBody3D RigidBody2D RigidBody3D StaticBody2D StaticBody3D Area2D Area3D
    Sprite2D AnimatedSprite2D Camera2D Camera3D Label Button Panel TextureRect VBoxContainer HBoxContainer MarginContainer EditorPlugin""".split()
)
RESOURCE_TYPES = set("Resource Script GDScript CSharpScript Shader Texture2D ImageTexture PackedScene Material StandardMaterial3D AudioStream Font Mesh MeshLibrary".split())
GD, CSHARP = "GDScript", "CSharp"
LANGUAGES = {".gd": GD, ".cs": CSHARP}
SCENES = (".tscn", ".scn")
_STRING = r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_TOKENS = {
    GD: re.compile(rf"(?P<comment>#[^\n]*)|(?P<string>{_STRING})|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<number>[0-9][A-Za-z0-9_.]*)|(?P<mark>->|::|[^\s])"),
    CSHARP: re.compile(rf"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>@\"(?:[^\"]|\"\")*\"|{_STRING})|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<number>[0-9][A-Za-z0-9_.]*)|(?P<mark>->|::|[^\s])"),
}
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Marks that rules look for from where they stand.
_SOUGHT = frozenset(("(", ")", "[", "]", "{", ":", ">", "->"))
#: Tokens behind `Array[` that are looked at for the type of its elements.
ARRAY_TYPES = 1000


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    column: int


def tokens(source: str, language: str, limits: Limits) -> tuple[list[Token], bool]:
    """The tokens without comments, and whether a limit was passed or a string left open. Columns count bytes from 1."""
    out, line, start, at, over, plain = [], 1, 0, 0, False, source.isascii()
    for m in _TOKENS[language].finditer(source):
        breaks = source.count("\n", at, m.start())
        if breaks:
            line, start = line + breaks, source.rfind("\n", at, m.start()) + 1
        at = m.start()
        if m.lastgroup == "comment":
            continue
        over |= m.lastgroup == "mark" and m[0] in "\"'"
        if len(out) >= limits.tokens:
            return out, True
        text = m[0].lstrip("@") if m.lastgroup == "string" else m[0]
        column = at - start if plain else len(encoded(source[start:at]))
        out.append(Token(m.lastgroup, text, line, column + 1))
    return out, over


def decoded(source: bytes) -> str:
    """UTF-8 text; bytes that are none stay as they are."""
    return source.decode("utf-8", "surrogateescape")


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def clean(text: str) -> str:
    """Text that tables can hold: bytes that are no UTF-8 become replacement signs."""
    return encoded(text).decode("utf-8", "replace")


def unquoted(text: str) -> str:
    for quote in ('"""', "'''", '"', "'"):
        if len(text) >= 2 * len(quote) and text.startswith(quote) and text.endswith(quote):
            return text[len(quote) : -len(quote)]
    return text


def relative(path: str) -> str:
    """A project path without its scheme and its dot segments."""
    parts: list[str] = []
    for p in path.replace("\\", "/").removeprefix("res://").split("/"):
        if p == "..":
            del parts[-1:]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


class Dependencies:
    """The dependency rules of both languages over a list of tokens. A token starts at most one rule; the first that fits has it."""

    def __init__(self, found: list[Token], language: str, most: int):
        self.t, self.language, self.most, self.out, self.over = found, language, most, [], False
        self.end = Token("end", "", 0, 0)
        self.class_name = self.base_type = ""
        self.global_class = False
        self.export = ""  # of C#: "open" inside an export attribute, "due" behind one
        self.places: dict[str, list[int]] = {}
        for i, token in enumerate(found):
            if token.text in _SOUGHT:
                self.places.setdefault(token.text, []).append(i)

    def next(self, mark: str, i: int) -> int:
        """The place of the next token `mark` at or after i; the number of tokens if there is none."""
        some = self.places.get(mark, ())
        k = bisect_left(some, i)
        return some[k] if k < len(some) else len(self.t)

    def at(self, i: int) -> Token:
        return self.t[i] if 0 <= i < len(self.t) else self.end

    def texts(self, i: int, *expected: str) -> bool:
        return all(self.at(i + k).text == x for k, x in enumerate(expected))

    def add(self, kind: str, token: Token, confidence: float, text: str, *, path: str | None = None, cls: str | None = None, uid: str | None = None, dynamic: bool = False) -> None:
        """An edge at a token; a class is also the symbol that a reference looks for."""
        if len(self.out) >= self.most:
            self.over = True
            return
        bound = path is not None or cls is not None or uid is not None
        self.out.append(
            {
                "dependency_kind": kind, "source_symbol_local_id": None, "reference_text": clean(text), "line_start": token.line, "column_start": token.column,
                "line_end": token.line, "column_end": token.column, "confidence": confidence, "is_dynamic": dynamic, "is_resolved": path is not None, "is_unresolved": not bound and not dynamic,
                "target_project_relative_path": path, "target_class_name": cls, "target_symbol_name": cls, "target_resource_uid": uid,
            }
        )

    def add_class(self, kind: str, token: Token, confidence: float) -> None:
        self.add(kind, token, confidence, token.text, cls=token.text)

    def path_at(self, i: int) -> str:
        """The project path of a string token, if it holds one."""
        token = self.at(i)
        literal = unquoted(token.text) if token.kind == "string" else ""
        return clean(relative(literal)) if literal.startswith("res://") else ""

    def add_path(self, kind: str, i: int) -> None:
        if path := self.path_at(i):
            self.add(kind, self.at(i), 1.0, f"res://{path}", path=path)

    def type_at(self, i: int, kind: str) -> None:
        """The class that a type names; of an array the first of its elements that is one."""
        token = self.at(i)
        if token.kind != "name":
            return
        if token.text.lower() == "array" and self.texts(i + 1, "["):
            for j in range(i + 2, min(self.next("]", i + 2), i + 2 + ARRAY_TYPES)):
                if self.t[j].kind == "name" and self.t[j].text.lower() not in PRIMITIVES:
                    self.add_class("typed_array_element_ref", self.t[j], 0.85)
                    break
        elif token.text.lower() not in PRIMITIVES:
            self.add_class(kind, token, 0.9)

    def load(self, i: int, kind: str, call: Token, name: str) -> None:
        """A load whose argument stands at i: an edge at a literal path, a dynamic one at the call."""
        if self.at(i).kind == "string":
            self.add_path(kind, i)
        elif i < len(self.t):
            self.add("dynamic_load", call, 0.35, f"{name}(dynamic)", dynamic=True)

    def run(self) -> list[dict]:
        rules = self.gdscript if self.language == GD else self.csharp
        for i, token in enumerate(self.t):
            if self.over:
                break
            if token.kind == "string":
                if (uid := unquoted(token.text)).startswith("uid://"):
                    self.add("resource_uid_ref", token, 1.0, uid, uid=clean(uid))
            elif token.kind == "name" or self.language == CSHARP:
                rules(i, token)
        return self.out

    def typed_list(self, i: int, kind: str) -> int:
        """The types behind each `:` of the next list in brackets at or after i; the place of its end."""
        i = self.next("(", i)
        end = self.next(")", i)
        i = self.next(":", i)
        while i < end and not self.over:
            self.type_at(i + 1, kind)
            i = self.next(":", i + 1)
        return end

    def first_type(self, i: int, kind: str, last_line: int) -> None:
        """The type behind the first `:` from i on, up to a line."""
        i = self.next(":", i)
        if i < len(self.t) and self.t[i].line <= last_line:
            self.type_at(i + 1, kind)

    def gdscript(self, i: int, token: Token) -> None:
        word, after, called = token.text, self.at(i + 1), self.texts(i + 1, "(")
        if word == "class_name" and after.kind == "name":
            self.class_name = self.class_name or after.text
            self.add_class("class_name_declaration", after, 1.0)
        elif word == "extends" and after.kind != "end":
            if self.path_at(i + 1):
                self.add_path("extends_path", i + 1)
                self.base_type = self.base_type or "ScriptPath"
            elif after.kind == "name":
                self.add_class("extends_class", after, 0.95)
                self.base_type = self.base_type or after.text
        elif word == "const" and after.kind == "name" and self.texts(i + 2, "=", "preload", "(") and self.at(i + 5).kind == "string":
            if path := self.path_at(i + 5):
                self.add("const_preload_alias", after, 1.0, after.text, path=path)
        elif word == "preload" and called and self.at(i + 2).kind != "end":
            self.load(i + 2, "preload_path", token, "preload")
        elif word == "ResourceLoader" and self.texts(i + 1, ".", "load", "(") and self.at(i + 4).kind != "end":
            self.load(i + 4, "resource_loader_load_path", token, "ResourceLoader.load")
        elif word == "load" and called and self.at(i + 2).kind != "end":
            if not (i >= 2 and self.texts(i - 1, ".")):
                self.load(i + 2, "load_path", token, "load")
        elif word == "var":
            self.first_type(i + 1, "typed_var_ref", token.line)
        elif word == "func":
            j = self.typed_list(i + 1, "typed_param_ref")
            # an arrow counts up to two lines below, or right behind the list
            arrow = self.next("->", j)
            if arrow < len(self.t) and (arrow == j or self.t[arrow - 1].line <= token.line + 2):
                self.type_at(arrow + 1, "typed_return_ref")
        elif word == "signal":
            self.typed_list(i + 1, "signal_type_ref")
        elif word == "NodePath" and called and self.at(i + 2).kind == "string":
            self.add("scene_node_path", self.at(i + 2), 0.95, unquoted(self.at(i + 2).text))
        elif self.texts(i + 1, ".", "new", "("):
            if word.lower() not in PRIMITIVES:
                self.add_class("new_class_instantiation", token, 0.8)
        elif word == "export" and after.kind != "end":
            self.first_type(i + 1, "export_type_ref", token.line + 1)

    def csharp(self, i: int, token: Token) -> None:
        word, after = token.text.lower(), self.at(i + 1)
        if token.kind != "name":
            if word == "[" and after.kind == "name":
                self.global_class |= after.text.lower() in ("globalclass", "globalclassattribute")
                if after.text.lower() in ("export", "exportattribute"):
                    self.export = "open"
            elif word == "]" and self.export:
                self.export = "due"
            return
        if word == "class" and after.kind == "name":
            if self.global_class:
                self.class_name = self.class_name or after.text
                self.add_class("class_name_declaration", after, 1.0)
            j = i + 3 if self.texts(i + 2, ":") else len(self.t)
            end = self.next("{", j)
            while j < end and not self.over:
                if self.t[j].kind == "name":
                    self.base_type = self.base_type or self.t[j].text
                    self.add_class("extends_class", self.t[j], 0.95)
                j += 1
            return
        if self.export == "due" and word not in MODIFIERS:
            self.type_at(i, "export_type_ref")
            self.export = ""
        called = self.at(i + 2).text.lower() if self.texts(i + 1, ".") else ""
        if word in ("gd", "resourceloader") and called == "load":
            j = i + 3
            if self.texts(j, "<"):
                if self.at(j + 1).kind == "name":
                    self.add_class("typed_return_ref", self.at(j + 1), 0.7)
                j = self.next(">", j) + 1
            if self.texts(j, "("):
                kind, name = ("gd_load_path", "GD.Load") if word == "gd" else ("resource_loader_load_path", "ResourceLoader.Load")
                self.load(j + 1, kind, token, name)
        elif word == "packedscene" and called == "instantiate" and self.texts(i + 3, "<"):
            of = self.at(i + 4)
            if of.kind == "name" and of.text.lower() not in PRIMITIVES:
                self.add_class("new_class_instantiation", of, 0.9)


class Symbols(list):
    """The symbols of a script in the order in which they were found; `root` is its first class."""

    root: dict | None = None


def _symbol(symbols: Symbols, kind: str, name: str, line: int, signature: str, language: str, parent: int | None = None, flags: int = 4, **more: Any) -> dict:
    owner = symbols.root["name"] if symbols.root else ""
    out = {
        "local_symbol_id": len(symbols) + 1, "parent_local_symbol_id": parent, "symbol_kind": kind, "name": name, "qualified_name": f"{owner}.{name}" if owner and kind != "class" else name, "class_name": name if kind == "class" else owner,
        "language": language, "declared_type": "", "return_type": "", "default_value_excerpt": "", "visibility": "public", "signature_text": signature, "doc_comment_state": "missing", "symbol_name": name, "symbol_flags": flags,
        "line_start": line, "column_start": 1, "line_end": line, "column_end": 1,
    } | more
    symbols.append(out)
    if kind == "class" and symbols.root is None:
        symbols.root = out
    return out


def _parameters(symbols: Symbols, function: dict, listed: str, line: int, language: str) -> None:
    for part in clean(listed).split(")")[0].split(","):
        declared, _, default = part.partition("=")
        if language == GD:
            name, _, kind = declared.partition(":")
            name, kind = name.strip(), kind.strip()
        else:
            words = [w for w in declared.split() if w not in ("ref", "out", "in", "params", "this")]
            name, kind = (words[-1], " ".join(words[:-1])) if words else ("", "")
        if m := _NAME.match(name):
            _symbol(symbols, "parameter", m[0], line, part.strip(), language, function["local_symbol_id"], declared_type=kind, default_value_excerpt=default.strip()[:120])


#: A name, its type and its value. Possessive, so that a line is gone through once.
_DECLARED = r"(?P<name>[A-Za-z_]\w*+)\s*+(?::(?P<type>[\w.\[\],\s]++|(?==)))?(?::?=\s*+(?P<value>.*))?$"
_GD_RULES = (
    ("class", re.compile(r"class_name\s+(?P<name>[A-Za-z_]\w*)")),
    ("function", re.compile(r"func\s+(?P<name>[A-Za-z_]\w*)\s*\((?P<list>[^)]*)\)?(?:\s*->\s*(?P<returns>[\w.\[\], ]+))?")),
    ("signal", re.compile(r"signal\s+(?P<name>[A-Za-z_]\w*)")),
    ("enum", re.compile(r"enum\s+(?P<name>[A-Za-z_]\w*)")),
    ("constant", re.compile(rf"const\s+{_DECLARED}")),
    ("property", re.compile(rf"var\s+{_DECLARED}")),
)
#: Patterns that are searched for in a line: each starts only where a run of its first characters does, and takes runs whole.
_CS_RULES = (
    ("class", re.compile(r"(?<!\S)class\s++(?P<name>[A-Za-z_]\w*+)")),
    ("signal", re.compile(r"\bevent\s++[\w.<>]++\s++(?P<name>[A-Za-z_]\w*+)")),
    ("property", re.compile(r"(?<![\w.<>\[\]])(?P<type>[\w.<>\[\]]++)\s++(?P<name>[A-Za-z_]\w*+)\s*+\{\s*+(?:get|set)\b")),
    ("function", re.compile(r"(?<!\w)[^\WA-Za-z_]*+(?P<name>[A-Za-z_]\w*+)\s*+(?:<[^>]{0,1000}+>)?\((?P<list>.*)\)")),
)


def _found(kind: str, pattern: re.Pattern, line: str) -> re.Match | None:
    """A C# rule in a line: of classes one that begins it, else the last, of events the last, of properties and functions the first. A function's list goes up to the
    line's last bracket."""
    if kind == "class" and (m := pattern.match(line)):
        return m
    if kind in ("class", "signal"):
        word = "class" if kind == "class" else "event"
        end = len(line)
        # the last place from which the pattern fits; each place is tried once
        while (at := line.rfind(word, 0, end)) >= 0:
            if m := pattern.match(line, at):
                return m
            end = at + len(word) - 1
        return None
    if kind == "function":
        return pattern.search(line, 0, line.rfind(")") + 1) if ")" in line else None
    return pattern.search(line) if "{" in line else None
_MODIFIERS = {"@export": 1, "export": 1, "@onready": 16, "onready": 16, "static": 2}
#: Bits of script and symbol flags that this module sets.
HAS_CLASS, TOOL, EXTENDS_NODE, EXTENDS_RESOURCE, HAS_EXPORTS, HAS_SIGNALS, READY, PROCESS, PHYSICS, HAS_DOC, INCOMPLETE, DYNAMIC, UNRESOLVED = (1 << k for k in range(13))
_CALLBACKS = {"_ready": READY, "_process": PROCESS, "_physics_process": PHYSICS, "_Ready": READY, "_Process": PROCESS, "_PhysicsProcess": PHYSICS}


def _doc(lines: list[str], at: int, language: str) -> tuple[int, bool, str] | None:
    """(first line, attached, text) of the comment lines directly above line `at` (0-based)."""
    for mark, attached in (("##", True), ("#", False)) if language == GD else (("///", True),):
        first = at
        while first and lines[first - 1].strip().startswith(mark) and (attached or not lines[first - 1].strip().startswith("##")):
            first -= 1
        if first < at:
            return first, attached, "\n".join(x.rstrip("\r").lstrip()[len(mark) :].lstrip() for x in lines[first:at])
    return None


def parse_script(source: bytes | None, extension: str, tier: str = "full", limits: Limits | None = None) -> dict[str, Any]:
    """One script. Null source: io_error. Unknown extension: unsupported_language. Past a limit: what was found so far."""
    limits, language = limits or TIERS[tier], LANGUAGES.get(extension, "")
    out: dict[str, Any] = {"language": language, "status": "no_class", "parse_tier": tier, "class_name": "", "direct_base_type": "", "parse_error": "", "bytes_read": 0, "lines_scanned": 0, "tokens_generated": 0, "script_flags": 0, "limit_exceeded": False, "parser_incomplete": False, "is_node_type": False, "is_resource_type": False, "symbols": [], "dependencies": [], "references": [], "doc_comments": []}
    if not language or source is None:
        return out | ({"status": "unsupported_language"} if not language else {"status": "io_error", "parse_error": "failed_to_open"})
    over = len(source) > limits.size
    text = decoded(source[: limits.size])
    lines = text.split("\n")
    if len(lines) > limits.lines:
        over, lines = True, lines[: limits.lines]
    text = "\n".join(lines)
    found, open_ended = tokens(text, language, limits)
    rules = Dependencies(found, language, limits.dependencies)
    dependencies = rules.run()
    over = over or open_ended or rules.over
    symbols, docs, flags = Symbols(), [], 0
    stop = len(lines)
    for n, raw in enumerate(lines[:stop]):
        line, mods = raw.rstrip("\r"), 4
        if language == GD and (line[:1].isspace() or not line or line.startswith("#")):
            continue
        line = line.strip()
        if line.startswith("@tool") or line == "tool":
            flags |= TOOL
        if language == GD and line.startswith("extends "):
            base = line[8:].split("#")[0].strip()
            flags |= EXTENDS_NODE if "node" in base.lower() and "res://" not in base else EXTENDS_RESOURCE if "resource" in base.lower() or "res://" in line else 0
        while language == GD and (word := line.split(" ", 1)[0]) in _MODIFIERS and " " in line:
            mods, line = mods | _MODIFIERS[word], line.split(" ", 1)[1].lstrip()
        if language == CSHARP and (not line or line.startswith(("//", "/*", "*", "using ", "namespace "))):
            continue
        for kind, pattern in _GD_RULES if language == GD else _CS_RULES:
            if not (m := pattern.match(line) if language == GD else _found(kind, pattern, line)):
                continue
            named = m.groupdict()
            root = symbols.root
            if kind == "class" and root and language == GD:
                break
            part = lambda k: clean((named.get(k) or "").split("#")[0].strip())
            s = _symbol(symbols, kind, m["name"], n + 1, clean(line), language, root["local_symbol_id"] if root else None, mods, declared_type=part("type"), return_type=part("returns"), default_value_excerpt=part("value")[:120])
            if kind == "class":
                flags |= HAS_CLASS
                bases = line.partition(":")[2].strip().lower() if language == CSHARP else ""
                flags |= EXTENDS_NODE if "node" in bases else EXTENDS_RESOURCE if "resource" in bases else 0
            if kind == "signal":
                flags |= HAS_SIGNALS
            if mods & 1:
                flags |= HAS_EXPORTS
            flags |= _CALLBACKS.get(m["name"], 0) if kind == "function" else 0
            if doc := _doc(lines, n, language):
                first, attached, comment = doc[0], doc[1], clean(doc[2])
                summary = next((x.strip() for x in comment.split("\n") if x.strip()), "")
                s["doc_comment_state"] = "present" if attached else "detached"
                flags |= HAS_DOC
                docs.append({"symbol_local_id": s["local_symbol_id"], "target_kind": kind, "comment_style": "doc" if attached else "plain", "text_excerpt": summary or comment, "comment_text": comment, "summary_text": summary, "text_hash": hashlib.sha256(comment.encode()).hexdigest()[:16], "is_attached": attached, "line_start": first + 1, "line_end": n})
            if kind == "function":
                _parameters(symbols, s, named.get("list") or "", n + 1, language)
            break
    if rules.class_name and symbols.root is None:
        # declared where no line rule sees it: the script still has a root symbol, at its first line
        _symbol(symbols, "class", clean(rules.class_name), 1, clean(rules.class_name), language, declared_type=clean(rules.base_type), doc_comment_state="none")
        flags |= HAS_CLASS
    # each dependency belongs to the last symbol at or above its line, else to the class
    marks = sorted((s for s in symbols if s["symbol_kind"] != "parameter"), key=lambda s: s["line_start"])
    root = symbols.root
    at, current = 0, root
    for d in sorted(dependencies, key=lambda d: d["line_start"]):
        while at < len(marks) and marks[at]["line_start"] <= d["line_start"]:
            current, at = marks[at], at + 1
        d["source_symbol_local_id"] = current["local_symbol_id"] if current else None
        flags |= DYNAMIC if d["is_dynamic"] else UNRESOLVED if d["is_unresolved"] else 0
    name = rules.class_name or (root["name"] if root and language == GD else "")
    if name:
        out |= {"status": "parsed_class", "class_name": name}
    out |= {"direct_base_type": rules.base_type, "is_node_type": rules.base_type in NODE_TYPES, "is_resource_type": rules.base_type in RESOURCE_TYPES}
    if over:
        flags |= INCOMPLETE
        out |= {"limit_exceeded": True, "parser_incomplete": True, "parse_error": "limit_exceeded"}
    head = root or (symbols[0] if symbols else None)
    if head:
        from arbordex.functions.text import SCRIPT_TO_SYMBOL

        head["symbol_flags"] |= sum(1 << b for a, b in SCRIPT_TO_SYMBOL.items() if flags >> a & 1)
    references = [{("reference_kind" if k == "dependency_kind" else k): v for k, v in d.items()} for d in dependencies]
    return out | {"bytes_read": min(len(source), limits.size), "lines_scanned": len(lines), "tokens_generated": len(found), "script_flags": flags, "symbols": symbols, "dependencies": dependencies, "references": references, "doc_comments": docs}


_ATTRIBUTE = re.compile(r"([A-Za-z_]\w*)\s*=\s*(?:\"((?:\\.|[^\"\\])*)\"|([^\s\]\"]+))")


def _attributes(line: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, quoted, bare in _ATTRIBUTE.findall(line):
        out.setdefault(k, quoted or bare)
    return out


def parse_scene(source: bytes | None, limits: Limits = SCENE_LIMITS) -> dict[str, Any]:
    """External resources, and what each `script…=` line attaches to the node above it; of equal resource ids the last is kept."""
    out: dict[str, Any] = {"status": "no_class", "parse_error": "", "external_resources": [], "script_attachments": []}
    if source is None:
        return out | {"status": "io_error", "parse_error": "failed_to_open"}
    lines = clean(decoded(source[: limits.size])).split("\n")
    if len(source) > limits.size or len(lines) > limits.lines:
        out["parse_error"], lines = "limit_exceeded", lines[: limits.lines]
    resources: dict[str, dict] = {}
    path = name = kind = ""
    for n, raw in enumerate(lines, 1):
        line = raw.strip()
        if line.startswith("[ext_resource") and line.endswith("]"):
            a = _attributes(line)
            at = relative(a.get("path", ""))
            r = {"ext_resource_id": a.get("id", ""), "resource_type": a.get("type", ""), "resource_path": at, "resource_uid": a.get("uid", ""), "is_script_resource": "script" in a.get("type", "").lower() or at.lower().endswith((".gd", ".cs")), "is_resolved": bool(at or a.get("uid")), "line": n}
            resources[r["ext_resource_id"] or f"\0{n}"] = r
        elif line.startswith("[node") and line.endswith("]"):
            a = _attributes(line)
            name, kind, parent = a.get("name", ""), a.get("type", ""), a.get("parent", "")
            path = path if not name else name if parent in ("", ".") else f"{parent}/{name}"
        elif line.startswith("script") and "=" in line:
            value = line.split("=", 1)[1].strip()
            quoted = re.search(r"\"([^\"]*)\"|'([^']*)'", value)
            literal = (quoted[1] or quoted[2] or "") if quoted else ""
            a = {"node_path": path, "node_name": name, "node_type": kind, "ext_resource_id": "", "attachment_kind": "unknown", "script_project_relative_path": "", "script_uid": "", "is_dynamic": False, "is_resolved": False, "line": n}
            if value.startswith("ExtResource("):
                r = resources.get(literal, {})
                at = r.get("resource_path", "")
                a |= {"attachment_kind": "ext_resource", "ext_resource_id": literal, "script_project_relative_path": at, "script_uid": r.get("resource_uid", ""), "is_resolved": bool(at)}
            elif value[:1] in ("\"", "'"):
                a |= {"attachment_kind": "direct", "script_project_relative_path": relative(literal), "is_resolved": bool(relative(literal))}
            elif value.startswith("SubResource("):
                a["attachment_kind"] = "sub_resource"
            else:
                a["is_dynamic"] = True
            out["script_attachments"].append(a)
    return out | {"external_resources": list(resources.values())}


def parse_autoloads(source: bytes | None) -> list[dict[str, Any]]:
    """Name, target and singleton mark of each line of the [autoload] section."""
    out, inside = [], False
    for raw in (source or b"").decode("utf-8", "replace").split("\n"):
        line = raw.strip()
        if not line or line[0] in "#;":
            continue
        if line.startswith("["):
            inside = line == "[autoload]"
        elif inside and "=" in line:
            name, _, value = line.partition("=")
            value = unquoted(value.split(";")[0].strip())
            out.append({"autoload_name": name.strip(), "target_path": value.removeprefix("*"), "target_project_relative_path": relative(value.removeprefix("*")), "is_singleton": value.startswith("*")})
    return out


_RANGE = "line_start long, column_start long, line_end long, column_end long"
_EDGE = f"source_symbol_local_id long, reference_text string, confidence double, is_dynamic boolean, is_resolved boolean, is_unresolved boolean, target_project_relative_path string, target_class_name string, target_symbol_name string, target_resource_uid string, {_RANGE}"


def _nested(fields: str) -> str:
    return f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in fields.split(', '))}>>"


SCRIPT = ", ".join(
    [
        "language string, status string, parse_tier string, class_name string, direct_base_type string, parse_error string, bytes_read long, lines_scanned long, tokens_generated long, script_flags long, limit_exceeded boolean, parser_incomplete boolean, is_node_type boolean, is_resource_type boolean",
        "symbols " + _nested(f"local_symbol_id long, parent_local_symbol_id long, symbol_kind string, name string, qualified_name string, class_name string, language string, declared_type string, return_type string, default_value_excerpt string, visibility string, signature_text string, doc_comment_state string, symbol_name string, symbol_flags long, {_RANGE}"),
        "dependencies " + _nested(f"dependency_kind string, {_EDGE}"),
        "references " + _nested(f"reference_kind string, {_EDGE}"),
        "doc_comments " + _nested("symbol_local_id long, target_kind string, comment_style string, text_excerpt string, comment_text string, summary_text string, text_hash string, is_attached boolean, line_start long, line_end long"),
    ]
)
SCENE = "status string, parse_error string, external_resources " + _nested("ext_resource_id string, resource_type string, resource_path string, resource_uid string, is_script_resource boolean, is_resolved boolean, line long") + ", script_attachments " + _nested(
    "node_path string, node_name string, node_type string, ext_resource_id string, attachment_kind string, script_project_relative_path string, script_uid string, is_dynamic boolean, is_resolved boolean, line long"
)
AUTOLOADS = "autoloads " + _nested("autoload_name string, target_path string, target_project_relative_path string, is_singleton boolean")


def parsed(df: DataFrame, parse: Callable[[dict], dict], schema: str) -> DataFrame:
    """df's path with what `parse` makes of each row (path, extension, content). Rows are taken from a batch one by one and go on in
    batches of about a megabyte of sources, however large a script is."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(f"path string, {schema}")
    arrow = to_arrow_schema(made)

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                r = {name: b.column(k)[i].as_py() for k, name in enumerate(("path", "extension", "content"))}
                rows.append({"path": r["path"], **parse(r)})
                size += len(r["content"] or b"")
                if size > 1 << 20 or len(rows) >= 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.select("path", "extension", F.col("content").cast("binary").alias("content")).mapInArrow(run, made)


def parse_scripts(df: DataFrame, tier: str = "full") -> DataFrame:
    return parsed(df.where(F.col("extension").isin(*LANGUAGES)), lambda r: parse_script(r["content"], r["extension"], tier), SCRIPT)


def parse_scenes(df: DataFrame) -> DataFrame:
    return parsed(df.where(F.col("extension").isin(*SCENES)), lambda r: parse_scene(r["content"]), SCENE)


def parse_project_files(df: DataFrame) -> DataFrame:
    return parsed(df.where(F.col("path").endswith("project.godot")), lambda r: {"autoloads": parse_autoloads(r["content"])}, AUTOLOADS)
