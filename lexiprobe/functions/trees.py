"""Syntax trees of programs in Java, C++, C, JavaScript, PHP, Go and Ruby, as tables of nodes with kind, span and parent.

One tokenizer and one recursive-descent parser serve all of them; what differs is said by ``LANGUAGES``. The
parser keeps what the extractors ask for: functions and what nests in them, declarations with their
blocks, loops, tests, and the shape of expressions. A type makes no names. Text that it cannot read is passed over a
token at a time, so that one odd place leaves the rest of a program readable.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Language:
    typed: bool = False  # declarations begin with a type
    lines: bool = False  # a newline ends a statement
    comments: str = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
    strings: str = r'"(?:\\.|[^"\\\n])*"?' + r"|'(?:\\.|[^'\\\n])*'?"
    names: str = r"[^\W\d]\w*"
    member_names: bool = False  # the name behind a dot is an identifier like others
    reserved: frozenset = frozenset()  # words that no variable has as its name
    modifiers: frozenset = frozenset()  # words that may stand before a declaration


def _words(text: str) -> frozenset:
    return frozenset(f"if else while for do return break continue switch case default {text}".split())


_C_MODIFIERS = frozenset("const static virtual inline explicit constexpr volatile register extern mutable friend typename unsigned signed struct class enum union thread_local".split())
_JAVA_MODIFIERS = frozenset("public private protected static final abstract synchronized native transient volatile strictfp default sealed".split())
LANGUAGES = {
    "Java": Language(typed=True, strings=r'"""(?:\\.|.)*?"""|' + Language.strings, member_names=True, reserved=_words("new try catch finally throw class interface enum import package instanceof goto"), modifiers=_JAVA_MODIFIERS),
    "C++": Language(typed=True, comments=Language.comments + r"|(?m:^[ \t]*\#(?:\\\n|[^\n])*)", strings=r'R"\((?:.)*?\)"|' + Language.strings, reserved=_words("new try catch throw delete class struct enum namespace using sizeof goto operator"), modifiers=_C_MODIFIERS),
    "Javascript": Language(strings=Language.strings + r"|`(?:\\.|[^`\\])*`?", names=r"[$#]?(?:[^\W\d]|\$)[\w$]*", reserved=_words("new try catch finally throw delete function class typeof await yield in instanceof var let const import export void")),
    "PHP": Language(comments=Language.comments + r"|\#(?!\[)[^\n]*|<\?php|<\?=?|\?>", strings=r'"(?:\\.|[^"\\])*"?' + r"|'(?:\\.|[^'\\])*'?", names=r"\$?[^\W\d][\w]*", reserved=_words("new try catch finally throw function fn class interface trait enum namespace use echo print instanceof and or elseif clone foreach")),
    "Go": Language(lines=True, strings=r"`[^`]*`?|" + Language.strings, reserved=_words("func package import go defer range select struct interface map chan var const type goto fallthrough")),
    "Ruby": Language(lines=True, comments=r"(?m:^=begin\b).*?(?m:^=end\b[^\n]*)|\#[^\n]*", strings=r'"(?:\\.|[^"\\])*"?' + r"|'(?:\\.|[^'\\])*'?|`[^`]*`?|(?<!:):[^\W\d]\w*[?!]?", names=r"@{0,2}[^\W\d]\w*[?!]?(?!\w)|\$\w+", member_names=True, reserved=frozenset("if else elsif end while until unless for in do return break next redo case when then begin rescue ensure def class module not and or yield super".split())),
}
LANGUAGES["C"] = LANGUAGES["C++"]
_OPERATORS = ">>>= <<= >>= === !== **= &&= ||= ??= <=> ... ?-> && || ?? == != <= >= ++ -- += -= *= /= %= &= |= ^= -> => :: := <- << ?. &. ** .. =~".split()
_PUNCTUATION = "|".join(re.escape(o) for o in sorted(_OPERATORS, key=len, reverse=True)) + r"|\S"
#: How tightly operators bind; what is not named binds as an assignment if it ends with =.
_BINDS = {
    o: n
    for n, ops in enumerate(("or", "and", "= := =>", "?", "?? ?:", "||", "&&", "|", "^", "&", "== != === !== =~ <=>", "< > <= >= instanceof in", ".. ...", "<< >> >>>", "+ - .", "* / %", "**"), 1)
    for o in ops.split()
}
_ASSIGN, _TERNARY, _UNARY = 3, 4, 18
_LITERALS = frozenset("true false null nil undefined NULL nullptr this self super".split())


@dataclass(slots=True)
class Node:
    """A node; ``test`` and ``value`` are among ``kids``, ``text`` is its name, its literal or its operator."""

    kind: str
    s: int
    e: int
    text: str = ""
    kids: list[Node] = field(default_factory=list)
    test: Node | None = None
    value: Node | None = None

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in the order of the text."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.kids))


@dataclass(slots=True, frozen=True)
class Token:
    kind: str  # name, number, string, op, end
    text: str
    s: int
    e: int
    fresh: bool  # first of its line


@lru_cache(maxsize=16)
def _pattern(language: str) -> re.Pattern:
    how = LANGUAGES[language]
    return re.compile(rf"(?P<skip>\s+|{how.comments})|(?P<string>{how.strings})|(?P<number>\d[\w.]*)|(?P<name>{how.names})|(?P<op>{_PUNCTUATION})", re.DOTALL)


def tokens(code: str, language: str) -> list[Token]:
    """The tokens of a program, without comments and white space, and end tokens enough to look ahead."""
    out, fresh = [], True
    for m in _pattern(language).finditer(code):
        if m.lastgroup == "skip":
            fresh = fresh or "\n" in m[0]
        else:
            out.append(Token(m.lastgroup, m[0], m.start(), m.end(), fresh))
            fresh = False
    return out + [Token("end", "", len(code), len(code), True)] * 8


class Parser:
    """Reads one program; :meth:`program` gives its root."""

    def __init__(self, code: str, language: str):
        self.language, self.how = language, LANGUAGES[language]
        self.toks, self.i, self.depth, self.no_brace = tokens(code, language), 0, 0, False
        self.last = next(i for i, t in enumerate(self.toks) if t.kind == "end")
        self.pairs = self._pairs()

    def _pairs(self) -> dict[int, int]:
        """The place of each closing bracket by that of its opening one."""
        out, stack = {}, []
        for i, t in enumerate(self.toks):
            if t.text in ("(", "[", "{") and t.kind == "op":
                stack.append((t.text, i))
            elif t.text in (")", "]", "}") and t.kind == "op":
                while stack and {"(": ")", "[": "]", "{": "}"}[stack[-1][0]] != t.text and t.text == "}":
                    stack.pop()  # an unclosed round or square bracket ends with its block
                if stack and {"(": ")", "[": "]", "{": "}"}[stack[-1][0]] == t.text:
                    out[stack.pop()[1]] = i
        return out

    # --- tokens ---

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def at(self, *texts: str) -> bool:
        t = self.toks[self.i]
        return t.text in texts and t.kind in ("op", "name")

    def peek(self, n: int = 1) -> Token:
        return self.toks[min(self.i + n, len(self.toks) - 1)]

    def take(self) -> Token:
        t = self.tok
        if t.kind != "end":
            self.i += 1
        return t

    def eat(self, *texts: str) -> bool:
        if self.at(*texts):
            self.take()
            return True
        return False

    def close_of(self, i: int) -> int:
        """The token that closes the bracket at ``i``; the end if none does."""
        return self.pairs.get(i, self.last)

    def done(self, node: Node) -> Node:
        node.e = max(node.s, self.toks[self.i - 1].e if self.i else node.e)
        return node

    def node(self, kind: str, text: str = "") -> Node:
        return Node(kind, self.tok.s, self.tok.e, text)

    def word(self, i: int | None = None) -> bool:
        """Whether the token is a name that can be a variable's."""
        t = self.toks[self.i if i is None else min(i, len(self.toks) - 1)]
        return t.kind == "name" and t.text not in self.how.reserved and t.text not in _LITERALS and t.text not in self.how.modifiers

    def name_node(self) -> Node:
        t = self.take()
        return Node("name", t.s, t.e, t.text.lstrip("$") if self.language == "PHP" else t.text)

    def skip_to(self, end: int) -> None:
        self.i = max(self.i, min(end, self.last))

    # --- statements ---

    def program(self) -> Node:
        root = Node("program", 0, self.toks[-1].e)
        self.statements(root, ())
        return root

    def statements(self, into: Node, ends: tuple[str, ...], member: bool = False) -> None:
        while self.tok.kind != "end" and not self.at(*ends):
            before = self.i
            found = self.statement(member)
            into.kids.extend([found] if found else [])
            if self.i == before:
                self.take()

    def block(self, kind: str = "block", member: bool = False) -> Node:
        """{ ... }, or one statement."""
        node = self.node(kind)
        if self.at("{"):
            end, saved, self.depth, brace, self.no_brace = self.close_of(self.i), self.depth, 0, self.no_brace, False
            self.take()
            while self.i < end:
                before = self.i
                found = self.statement(member)
                node.kids.extend([found] if found else [])
                if self.i == before:
                    self.take()
            self.skip_to(end)
            self.eat("}")
            self.depth, self.no_brace = saved, brace
        else:
            found = self.statement()
            node.kids.extend([found] if found else [])
        return self.done(node)

    def statement(self, member: bool = False) -> Node | None:
        t = self.tok
        if self.eat(";"):
            return None
        if t.kind == "op" and t.text == "{" and self.language != "Ruby":
            return self.block()
        if t.text == "@" and self.language == "Java" and self.peek().kind == "name" and self.peek().text != "interface":
            self.i += 2
            if self.at("("):
                self.skip_to(self.close_of(self.i) + 1)
            found = self.statement(member)
            if found is not None:
                found.s = t.s  # an annotation belongs to what follows
            return found
        if t.text in self.how.modifiers and self.how.typed:
            j = self.i
            while self.toks[j].text in self.how.modifiers - {"class", "struct", "union", "enum"} or self.toks[j].text == "@" and self.toks[j + 1].text != "interface":
                j += 1 if self.toks[j].text != "@" else 2
                j = self.close_of(j) + 1 if self.toks[j].text == "(" and self.toks[j - 2].text == "@" else j
            if self.toks[j].text in ("class", "interface", "enum", "record", "struct", "union") and j > self.i:
                saved, self.i = self.i, j
                found = getattr(self, f"_{self.tok.text}_", lambda: NotImplemented)()
                if found is not NotImplemented:
                    return found
                self.i = saved
        if t.kind == "name":
            method = getattr(self, f"_{t.text}_", None) if re.fullmatch(r"[a-z]+", t.text) else None
            if method and not (member and self.peek().text == "(") and self.peek().text not in (".", "=", ":"):
                found = method()
                if found is not NotImplemented:
                    return found
            if member and self.language == "Javascript":
                return self._js_member()
            if self.how.typed:
                found = self._declaration(member)
                if found is not None:
                    return found
        if self.language == "C++" and t.text == "~" or member and self.language == "C++" and t.text == "::":
            self.take()
        if member and self.language == "Javascript" and (t.text in ("*", "[", "#") or t.kind in ("string", "number")):
            return self._js_member()
        node = self.expression()
        if node is None:
            return None
        if self.language == "Go" and self.at(",", "=", ":="):
            node = self._go_assign(node)
        elif self.language == "Ruby":
            node = self._ruby_tail(node)
        elif self.at(":") and node.kind == "name":
            self.take()  # a label
        return node

    def condition(self) -> Node | None:
        """The test of a statement: ( ... ) where the language asks for brackets."""
        if self.language in ("Go", "Ruby"):
            saved, self.no_brace = self.no_brace, True
            node = self.expression()
            self.no_brace = saved
            return node
        if not self.at("("):
            return None
        node = self.node("paren")
        end = self.close_of(self.i)
        self.take()
        self.depth += 1
        declared = self._declaration(False) if self.how.typed and self.word() else None
        if declared is None and self.i < end:
            inner = self.expression()
            node.kids.extend([inner] if inner else [])
        self.depth -= 1
        extra = self.i < end
        self.skip_to(end)
        self.eat(")")
        if declared is not None:
            node.kids.append(declared)
        node.kind = "header" if declared is not None or extra else "paren"
        return self.done(node)

    def _if_(self) -> Node:
        node = self.node("if")
        self.take()
        if self.language == "Ruby":
            return self._ruby_if(node)
        self.eat("constexpr")
        test = self.condition()
        if self.language == "Go" and self.at(",", "=", ":=", ";"):  # a statement before the test: no test of its own
            if not self.at(";"):
                test = self._go_assign(test)
            if self.eat(";"):
                node.kids.extend([test] if test else [])
                saved, self.no_brace = self.no_brace, True
                later = self.expression()
                self.no_brace = saved
                node.kids.extend([later] if later else [])
                test = None
        if test is not None:
            node.kids.append(test)
            node.test = test if test.kind != "header" else None
        if self.eat(":"):  # PHP: if (...): ... endif
            self.statements(node, ("elseif", "else", "endif"))
            while self.at("elseif", "else"):
                if self.take().text == "elseif":
                    later = self.condition()
                    node.kids.extend([later] if later else [])
                self.eat(":")
                self.statements(node, ("elseif", "else", "endif"))
            self.eat("endif")
            return self.done(node)
        node.kids.append(self.block())
        while self.at("elseif") or self.at("else"):
            if self.take().text == "elseif":  # a clause of the if, not an if of its own
                later = self.condition()
                node.kids.extend([later] if later else [])
            node.kids.append(self.block())
        return self.done(node)

    def _while_(self) -> Node:
        node = self.node("while")
        self.take()
        test = self.condition()
        if test is not None:
            node.kids.append(test)
            node.test = test if test.kind != "header" else None
        if self.language == "Ruby":
            self.eat("do")
            self.statements(node, ("end",))
            self.eat("end")
        elif self.eat(":"):
            self.statements(node, ("endwhile",))
            self.eat("endwhile")
        else:
            node.kids.append(self.block())
        return self.done(node)

    def _do_(self) -> Node:
        node = self.node("do")
        self.take()
        node.kids.append(self.block())
        if self.eat("while"):
            test = self.condition()
            node.kids.extend([test] if test else [])
        return self.done(node)

    def _for_(self) -> Node:
        if self.language == "Go":
            return self._go_for()
        node = self.node("for")
        self.take()
        if self.language == "Ruby":
            names = self.expression()
            self.eat("in")
            over = self.expression()
            node.kids.extend(x for x in (names, over) if x)
            node.kind = "foreach"
            self.eat("do")
            self.statements(node, ("end",))
            self.eat("end")
            return self.done(node)
        self.eat("await")
        end = self.close_of(self.i)
        self.eat("(")
        self.depth += 1
        parts: list[Node | None] = []
        while self.i < end:
            before, part = self.i, None
            if not self.at(";"):
                part = self._var(self.take()) if self.at("let", "const", "var") and not self.how.typed else self._declaration(False, True) if self.how.typed and not parts else None
                part = part or self.expression(stop_in=not parts)
                while self.eat(","):
                    more = self.expression()
                    node.kids.extend([more] if more else [])
            if part is not None:
                node.kids.append(part)
            if self.at(":", "of", "in"):
                node.kind = "foreach"
                self.take()
                over = self.expression()
                node.kids.extend([over] if over else [])
            parts.append(part)
            if not self.eat(";") and self.i == before:
                self.take()
        self.depth -= 1
        self.eat(")")
        node.test = parts[1] if node.kind == "for" and len(parts) > 1 else None
        if self.eat(":"):
            self.statements(node, ("endfor",))
            self.eat("endfor")
        else:
            node.kids.append(self.block())
        return self.done(node)

    def _foreach_(self) -> Node:
        node = self.node("foreach")
        self.take()
        end = self.close_of(self.i)
        self.eat("(")
        while self.i < end:
            before = self.i
            part = self.expression()
            node.kids.extend([part] if part else [])
            if self.i == before:
                self.take()
        self.skip_to(end)
        self.eat(")")
        if self.eat(":"):
            self.statements(node, ("endforeach",))
            self.eat("endforeach")
        else:
            node.kids.append(self.block())
        return self.done(node)

    def _switch_(self) -> Node:
        node = self.node("switch")
        self.take()
        if self.language == "Go":
            if not self.at("{"):
                saved, self.no_brace = self.no_brace, True
                self.statements(node, ("{",))
                self.no_brace = saved
        else:
            test = self.condition()
            node.kids.extend([test] if test else [])
        if self.at("{"):
            node.kids.append(self.block())
        return self.done(node)

    _select_ = _switch_
    _synchronized_ = _switch_

    def _case_(self) -> Node:
        node = self.node("case")
        self.take()
        if self.language == "Ruby":
            if not self.tok.fresh:
                subject = self.expression()
                node.kids.extend([subject] if subject else [])
            while self.eat("when", "in", ","):
                part = self.expression()
                node.kids.extend([part] if part else [])
                if not self.at(","):
                    self.eat("then")
                    self.statements(node, ("when", "in", "else", "end"))
            if self.eat("else"):
                self.statements(node, ("end",))
            self.eat("end")
            return self.done(node)
        while not self.at(":", "->", "{", "}") and self.tok.kind != "end":
            before = self.i
            part = self.expression(stop_arrow=True)
            node.kids.extend([part] if part else [])
            if self.i == before:
                self.take()
        self.eat(":", "->")
        return self.done(node)

    def _default_(self) -> Node | None:
        if self.peek().text not in (":", "->"):
            return NotImplemented
        self.i += 2
        return None

    def _try_(self) -> Node:
        node = self.node("try")
        self.take()
        if self.at("("):  # resources
            end = self.close_of(self.i)
            self.take()
            while self.i < end:
                before = self.i
                part = self._declaration(False) or self.expression()
                node.kids.extend([part] if part else [])
                if self.i == before or self.at(";"):
                    self.take()
            self.skip_to(end + 1)
        node.kids.append(self.block())
        while self.at("catch", "finally"):
            if self.take().text == "catch" and self.at("("):
                node.kids.extend(self.parameters())
            node.kids.append(self.block())
        return self.done(node)

    def _begin_(self) -> Node:
        if self.language != "Ruby":
            return NotImplemented
        node = self.node("begin")
        self.take()
        self._ruby_body(node)
        return self.done(node)

    def _return_(self) -> Node:
        node = self.node("return")
        t = self.take()
        if self.tok.kind != "end" and not self.at(";", "}", "end", "if", "unless") and not (self.tok.fresh and (self.how.lines or self.language == "Javascript")):
            node.value = self.expression()
            node.kids.extend([node.value] if node.value else [])
            while self.eat(","):
                more = self.expression()
                node.kids.extend([more] if more else [])
                if self.language != "Ruby":
                    node.value = None  # several values are no expression
        node.s = t.s
        self.done(node)
        return self._ruby_tail(node) if self.language == "Ruby" else node

    def _jump(self) -> Node:
        node = self.node("jump")
        self.take()
        if not self.tok.fresh and not self.at(";", "}", "if", "unless") and self.tok.kind != "end":
            inner = self.expression()
            node.kids.extend([inner] if inner else [])
        self.done(node)
        return self._ruby_tail(node) if self.language == "Ruby" else node

    _break_ = _continue_ = _goto_ = _throw_ = _jump

    def _own_jump(self):
        """Words that only one language has as a statement."""
        own = {"next": "Ruby", "raise": "Ruby", "defer": "Go", "go": "Go", "echo": "PHP", "print": "PHP"}
        return self._jump() if own[self.tok.text] == self.language else NotImplemented

    _next_ = _raise_ = _defer_ = _go_ = _echo_ = _print_ = _own_jump

    def _skip_line(self) -> None:
        """Passes over a statement that holds no names of variables."""
        line = self.take()
        while self.tok.kind != "end" and not self.at(";") and not (self.tok.fresh and self.how.lines):
            if self.at("(", "{"):
                self.skip_to(self.close_of(self.i))
            self.take()
        return None if line else None

    def _import_(self):
        return self._skip_line() if self.language in ("Java", "Go", "Javascript") else NotImplemented

    def _package_(self):
        return self._skip_line() if self.language in ("Java", "Go") else NotImplemented

    def _using_(self):
        return self._skip_line() if self.language in ("C++", "C") else NotImplemented

    _typedef_ = _using_

    def _use_(self):
        return self._skip_line() if self.language == "PHP" else NotImplemented

    def _type_(self):
        if self.language != "Go" or self.peek().kind != "name":
            return NotImplemented
        return self._skip_line()

    def _export_(self):
        """What is exported stands one level below."""
        if self.language != "Javascript":
            return NotImplemented
        node = self.node("export")
        self.take()
        self.eat("default")
        inner = self.statement()
        node.kids.extend([inner] if inner else [])
        return self.done(node)

    def _namespace_(self):
        if self.language not in ("C++", "PHP"):
            return NotImplemented
        node = self.node("namespace")
        self.take()
        while self.tok.kind != "end" and not self.at("{", ";"):
            self.take()
        if self.at("{"):
            node.kids.append(self.block())
        return self.done(node)

    def _extern_(self):
        if self.peek().kind != "string":
            return NotImplemented
        self.i += 2
        return self.block("namespace") if self.at("{") else None

    def _template_(self):
        if self.language != "C++":
            return NotImplemented
        self.take()
        self.skip_to(self.type_arguments(self.i) or self.i)
        return self.statement()

    # --- classes and functions ---

    def _class_(self):
        node = self.node("class")
        if self.language == "Ruby":
            self.take()
            while self.tok.kind != "end" and not self.tok.fresh and not self.at(";"):
                self.take()
            self._ruby_body(node)
            return self.done(node)
        j = self.i + 1
        while self.toks[j].kind != "end" and self.toks[j].text not in ("{", ";", "(", "=", ")"):
            j += 1
        if self.toks[j].text != "{":
            return NotImplemented if self.how.typed else self._skip_line()
        if self.language in ("C++", "C") and self.toks[j - 1].text == ")":
            return NotImplemented
        self.take()
        node.text = self.tok.text if self.tok.kind == "name" else ""
        self.i = j
        node.kids.append(self.block("members", member=True))
        return self.done(node)

    _interface_ = _trait_ = _union_ = _class_

    def _struct_(self):
        return self._class_() if self.language in ("C++", "C") else NotImplemented

    def _module_(self):
        return self._class_() if self.language == "Ruby" else NotImplemented

    def _enum_(self):
        node = self.node("enum")
        j = self.i + 1
        while self.toks[j].kind != "end" and self.toks[j].text not in ("{", ";", "(", "="):
            j += 1
        if self.toks[j].text != "{":
            return NotImplemented
        self.i = j
        if self.language in ("C++", "C"):
            self.skip_to(self.close_of(j) + 1)
        else:
            node.kids.append(self.block("members", member=True))
        return self.done(node)

    def _function_(self):
        """JavaScript and PHP: a declared function, or an expression."""
        if self.language not in ("Javascript", "PHP"):
            return NotImplemented
        n = 1 + (self.peek().text in ("*", "&"))
        if self.peek(n).kind != "name":
            return NotImplemented
        node = self.node("function")
        self.i += n
        return self._function_rest(node)

    def _async_(self):
        if self.language != "Javascript" or self.peek().text != "function":
            return NotImplemented
        start = self.take().s
        node = self._function_()
        if node is not NotImplemented:
            node.s = start
        return node

    def _function_rest(self, node: Node) -> Node:
        """Name, parameters, what stands before the body, and the body."""
        node.text = self.take().text
        if self.at("("):
            node.kids.extend(self.parameters())
        while self.tok.kind != "end" and not self.at("{", ";"):  # types and the like
            self.take()
        if self.at("{"):
            node.kids.append(self.block())
        return self.done(node)

    def _modifier_(self):
        if self.language != "PHP":
            return NotImplemented
        start = self.tok.s
        j = self.i
        while self.toks[j].text in ("public", "private", "protected", "static", "final", "abstract"):
            j += 1
        if self.toks[j].text not in ("function", "class"):
            return NotImplemented
        self.i = j
        node = self.statement()
        if node is not None:
            node.s = start
        return node

    _public_ = _private_ = _protected_ = _static_ = _final_ = _abstract_ = _modifier_

    def _func_(self):
        if self.language != "Go":
            return NotImplemented
        receiver = self.peek().text == "(" and self.toks[self.close_of(self.i + 1) + 1].kind == "name"
        if not receiver and self.peek().kind != "name":
            return NotImplemented
        node = self.node("function")
        self.take()
        if receiver:
            node.kids.extend(self.parameters())
        node.text = self.take().text
        return self._go_function(node)

    def _go_function(self, node: Node) -> Node:
        if self.at("["):
            self.skip_to(self.close_of(self.i) + 1)
        if self.at("("):
            node.kids.extend(self.parameters())
        while self.tok.kind != "end" and not self.at("{") and not self.tok.fresh:  # results
            self.skip_to(self.close_of(self.i)) if self.at("(") else None
            struct = self.take().text in ("struct", "interface")
            if struct and self.at("{"):
                self.skip_to(self.close_of(self.i) + 1)
        if self.at("{"):
            node.kids.append(self.block())
        return self.done(node)

    def _def_(self):
        if self.language != "Ruby":
            return NotImplemented
        node = self.node("function")
        self.take()
        node.text = self.take().text
        if self.at("."):
            node.kind = "singleton"
            self.take()
            node.text = self.take().text
        if self.at("("):
            node.kids.extend(self.parameters())
        else:
            while not self.tok.fresh and not self.at(";", "=") and self.tok.kind != "end":
                if self.word():
                    node.kids.append(self._param(self.tok))
                self.take()
        if self.eat("="):
            inner = self.expression()
            node.kids.extend([inner] if inner else [])
        else:
            self._ruby_body(node)
        return self.done(node)

    def _param(self, t: Token) -> Node:
        text = t.text.lstrip("$") if self.language == "PHP" else t.text
        return Node("param", t.s, t.e, text)

    def parameters(self) -> list[Node]:
        """( ... ) of a function: a node for each name it binds."""
        out, end = [], self.close_of(self.i)
        self.take()
        start, depth, angle, value = self.i, 0, 0, False
        names: list[Token] = []
        for j in range(start, end + 1):
            t = self.toks[j]
            depth += (t.text in ("(", "[", "{")) - (t.text in (")", "]", "}") and j < end)
            angle += (t.text == "<") - t.text.count(">") * (t.text in (">", ">>"))
            if j == end or t.text == "," and depth == 0 and angle <= 0:
                if names:
                    pick = names[0] if self.language in ("Javascript", "Go", "Ruby") else names[-1]
                    if self.how.typed and len(names) == 1 and not (self.toks[j - 1] is pick and self.toks[j - 2].text in ("*", "&", "]", ">", "...")) and all(x.kind == "name" and x is pick for x in self.toks[start:j]):
                        pick = None  # a type alone
                    out.extend([self._param(pick)] if pick else [])
                start, names, value, angle = j + 1, [], False, 0
            elif t.text in ("=", ":") and (self.language != "PHP" or t.text == "="):
                value = True
            elif t.kind == "name" and not value and self.word(j) and (self.language != "PHP" or t.text.startswith("$")) and (angle <= 0 and depth <= (1 if self.language == "Javascript" else 0)):
                names.append(t)
        self.skip_to(end)
        self.eat(")")
        return out

    def _js_member(self) -> Node | None:
        """A member of a class or an object literal: a method, a field."""
        node = self.node("function")
        while self.at("static", "async", "get", "set", "*") and self.peek().text not in ("(", "=", ";", ",", ":"):
            self.take()
        t = self.tok
        if self.at("["):
            self.skip_to(self.close_of(self.i) + 1)
            node.text = ""
        else:
            node.text = self.take().text
        if self.at("("):
            self.i -= 1
            self.toks[self.i] = Token("name", node.text, self.tok.s, self.tok.e, self.tok.fresh)
            return self._function_rest(node)
        field_node = Node("field", t.s, t.e, node.text)
        if self.eat("=", ":"):
            value = self.expression(_ASSIGN)
            field_node.kids.extend([value] if value else [])
        self.eat(",", ";")
        return self.done(field_node)

    # --- typed declarations ---

    def type_arguments(self, i: int) -> int | None:
        """Behind the < ... > at ``i`` if it can be a list of types."""
        if self.toks[i].text != "<":
            return None
        depth, j = 0, i
        while j < len(self.toks) and j < i + 200:
            t = self.toks[j]
            if t.text == "<":
                depth += 1
            elif t.text in (">", ">>", ">>>"):
                depth -= len(t.text)
                if depth <= 0:
                    return j + 1
            elif t.text in ("(", "["):
                j = self.close_of(j)
            elif t.kind == "op" and t.text not in (",", "::", ".", "*", "&", "?", "...", "&&", "="):
                return None
            elif t.kind == "string":
                return None
            j += 1
        return None

    def type_end(self, i: int) -> int | None:
        """Behind the type that begins at ``i``, or None."""
        toks, seen = self.toks, False
        while toks[i].text in self.how.modifiers and toks[i].kind == "name" or toks[i].text == "@":
            if toks[i].text == "@":
                i += 2
                i = self.close_of(i) + 1 if toks[i].text == "(" else i
                continue
            seen = seen or toks[i].text in ("unsigned", "signed")
            i += 1
        if toks[i].text == "<" and self.language == "Java":
            i = self.type_arguments(i) or i
        primitive = ("int", "long", "short", "char", "double")
        if toks[i].kind == "name" and (toks[i].text in primitive or seen):
            while toks[i].text in primitive:
                i += 1
                seen = True
            if not seen:
                return None
        elif self.word(i) or toks[i].text == "::":
            i += toks[i].text == "::"
            i += 1
            while True:
                if toks[i].text == "<":
                    j = self.type_arguments(i)
                    if j is None:
                        break
                    i = j
                elif toks[i].text in ("::", ".") and toks[i + 1].kind == "name":
                    i += 2
                else:
                    break
        else:
            return None
        while toks[i].text in ("*", "&", "&&", "const", "...") or toks[i].text == "[" and toks[i + 1].text == "]":
            i += 2 if toks[i].text == "[" else 1
        return i

    def _declaration(self, member: bool, header: bool = False) -> Node | None:
        """A declaration of variables or a function at the present token, or None and no step."""
        start, toks = self.i, self.toks
        if toks[start].text in self.how.reserved - self.how.modifiers:
            return None
        j = self.type_end(start)
        own = self._constructor(start) if j is not None else None
        if own is not None:
            return own
        if j is None or not (self.word(j) or toks[j].text in ("operator", "~", "[") or toks[j].text == "(" and toks[j + 1].text == "*"):
            return None
        if toks[j].text == "[" and not (self.language == "C++" and self.toks[j - 1].text in ("auto", "&")):
            return None
        if toks[j].text == "(" or toks[j].text == "[":  # a pointer to a function, or names bound at once
            self.i = self.close_of(j) + 1
            node = Node("binding", toks[start].s, toks[self.i - 1].e)
            for k in range(j, self.i):
                if self.word(k) and toks[j].text == "[":
                    node.kids.append(Node("declare", toks[k].s, toks[k].e, toks[k].text))
            if self.eat("="):
                value = self.expression()
                node.kids.extend([value] if value else [])
            return self.done(node)
        k, text = j, ""
        while toks[k].kind == "name" or toks[k].text in ("::", "~"):
            text += toks[k].text
            k += 1
            if toks[k].text == "<" and (e := self.type_arguments(k)) and toks[e].text == "::":
                k = e
            if toks[k].text not in ("::", "~") and toks[k - 1].text not in ("::", "~"):
                break
        if "operator" in text:
            while toks[k].text != "(" or toks[k + 1].text == ")" and toks[k + 2].text == "(":
                k += 1
                if toks[k].kind == "end":
                    return None
            text = ""
        if toks[k].text == "(":
            body = self._body_behind(self.close_of(k) + 1)
            if body is not None:
                return self._define(start, text, k, body)
            if self.language == "Java":
                if member:
                    self.skip_to(self.close_of(k) + 1)
                    return Node("declaration", toks[start].s, toks[self.i - 1].e)
                return None
            if "::" in text:
                return None
        elif toks[k].text not in ("=", ";", ",", "[", "{", ":") or toks[k].text == ":" and not (header or member):
            return None
        node = Node("fields" if member else "declaration", toks[start].s, toks[start].e)
        self.i = j
        while self.word():
            declared = self.node("declare", self.tok.text)
            declared.kids.append(self.name_node())
            while self.at("["):
                end = self.close_of(self.i)
                self.take()
                inner = self.expression() if self.i < end else None
                declared.kids.extend([inner] if inner else [])
                self.skip_to(end + 1)
            if self.eat("="):
                declared.value = self.expression(_ASSIGN)
                declared.kids.extend([declared.value] if declared.value else [])
            elif self.at("{", "(") and self.language != "Java":
                inner = self._brackets("list")
                declared.kids.append(inner)
            node.kids.append(self.done(declared))
            if not self.at(","):
                break
            self.take()
            while self.at("*", "&"):
                self.take()
        return self.done(node)

    def _constructor(self, i: int) -> Node | None:
        """C::C(...) { } of C++ and C(...) { } within a class."""
        toks, k, text = self.toks, i, ""
        while toks[k].text in self.how.modifiers:
            k += 1
        while toks[k].kind == "name" or toks[k].text in ("::", "~"):
            text += toks[k].text
            k += 1
            if toks[k].text == "<" and (e := self.type_arguments(k)) and toks[e].text == "::":
                k = e
            if toks[k].text not in ("::", "~") and toks[k - 1].text not in ("::", "~"):
                break
        if toks[k].text != "(" or not text or k > i and toks[k - 1].kind != "name" or not self.word(k - 1):
            return None
        body = self._body_behind(self.close_of(k) + 1)
        return None if body is None else self._define(i, text, k, body, constructor=self.language == "Java")

    def _body_behind(self, k: int) -> int | None:
        """The { of a function's body if only what may stand before it is between, from behind the parameters on."""
        toks = self.toks
        while toks[k].text in ("const", "noexcept", "override", "final", "&", "&&", "volatile", "->", "throws", "throw", ":", ",", "::", "*", "<", ">", "[", "]", ".", "@") or toks[k].kind == "name" and toks[k].text not in self.how.reserved or toks[k].text == "(" and toks[k - 1].kind == "name":
            listed = toks[k].text == ":"
            if toks[k].text == "(":
                k = self.close_of(k)
            k += 1
            if listed:
                while toks[k].kind == "name" or toks[k].text in ("::", ",", "<", ">"):
                    k += 1
                    if toks[k].text in ("(", "{") and toks[k - 1].kind == "name" and toks[k + 1].kind != "end":
                        nxt = self.close_of(k) + 1
                        if toks[k].text == "{" and toks[nxt].text not in (",", "{"):
                            return k
                        k = nxt
        return k if toks[k].text == "{" else None

    def _define(self, start: int, text: str, params: int, body: int, constructor: bool = False) -> Node:
        node = Node("constructor" if constructor else "function", self.toks[start].s, self.toks[start].e, text.rpartition("~")[2] if "~" not in text else "")
        self.i = params
        node.kids.extend(self.parameters())
        while self.i < body:  # initialisers of members
            if self.at("(", "{"):
                node.kids.append(self._brackets("list"))
            else:
                self.take()
        node.kids.append(self.block())
        return self.done(node)

    # --- JavaScript, Go and Ruby declarations ---

    def _var(self, keyword: Token) -> Node:
        node = Node("declaration", keyword.s, keyword.e, keyword.text)
        while True:
            declared = self.node("declare")
            if self.word():
                declared.text = self.tok.text
                declared.kids.append(self.name_node())
            elif self.at("{", "["):
                for k in range(self.i, self.close_of(self.i)):
                    if self.word(k) and self.toks[k + 1].text in (",", "}", "]", "="):
                        declared.kids.append(Node("param", self.toks[k].s, self.toks[k].e, self.toks[k].text))
                self.skip_to(self.close_of(self.i) + 1)
            if self.eat("="):
                declared.value = self.expression(_ASSIGN)
                declared.kids.extend([declared.value] if declared.value else [])
            node.kids.append(self.done(declared))
            if not self.eat(","):
                return self.done(node)

    def _let_(self):
        return self._var(self.take()) if self.language == "Javascript" else NotImplemented

    def _const_(self):
        return self._let_() if self.language == "Javascript" else self._var_() if self.language == "Go" else NotImplemented

    def _var_(self):
        if self.language == "Javascript":
            return self._var(self.take())
        if self.language != "Go":
            return NotImplemented
        node = self.node("declaration")
        self.take()
        ends = self.close_of(self.i) if self.eat("(") else None
        while self.word() or ends is not None and self.i < ends:
            if not self.word():
                self.take()
                continue
            declared = self.node("variable", self.tok.text)
            declared.kids.append(self.name_node())
            while self.tok.kind != "end" and not self.at("=", ")", ";") and not self.tok.fresh:
                self.take()
            if self.eat("="):
                while (value := self.expression()) is not None:
                    declared.kids.append(value)
                    if not self.eat(","):
                        break
            node.kids.append(self.done(declared))
            if ends is None:
                break
        return self.done(node)

    def _go_assign(self, left: Node | None) -> Node | None:
        """a, b = x, y and a := x."""
        if left is None:
            return None
        lefts = [left]
        while self.eat(","):
            more = self.expression()
            lefts.extend([more] if more else [])
        if not self.at("=", ":="):
            return left
        node = Node("assign", left.s, left.e, self.take().text, lefts)
        if self.eat("range"):
            node.text = "range"
        values = []
        while (value := self.expression()) is not None:
            values.append(value)
            if not self.eat(","):
                break
        node.kids = [*lefts, *values]
        node.value = values[0] if len(values) == 1 else None
        return self.done(node)

    def _go_for(self) -> Node:
        node = self.node("for")
        self.take()
        saved, self.no_brace = self.no_brace, True
        parts: list[Node | None] = [None]
        while self.tok.kind != "end" and not self.at("{"):
            before = self.i
            if self.eat(";"):
                parts.append(None)
                continue
            if self.eat("range"):
                node.kind = "foreach"
            part = self.expression()
            if self.at(",", "=", ":="):
                part = self._go_assign(part)
                if part is not None and part.text == "range":
                    node.kind = "foreach"
            parts[-1] = part
            node.kids.extend([part] if part else [])
            if self.i == before:
                self.take()
        self.no_brace = saved
        test = parts[0] if len(parts) == 1 else parts[1]
        if node.kind == "for" and test is not None and test.kind in (("name", "not", "unary", "paren", "binary", "logic", "compare") if len(parts) > 1 else (test.kind,)):
            node.test = test
        if self.at("{"):
            node.kids.append(self.block())
        return self.done(node)

    def _ruby_if(self, node: Node) -> Node:
        node.test = self.condition()
        node.kids.extend([node.test] if node.test else [])
        self.eat("then")
        self.statements(node, ("elsif", "else", "end"))
        while self.eat("elsif"):
            clause = self.node("elsif")
            later = self.condition()
            clause.kids.extend([later] if later else [])
            self.eat("then")
            self.statements(clause, ("elsif", "else", "end"))
            node.kids.append(self.done(clause))
        if self.eat("else"):
            self.statements(node, ("end",))
        self.eat("end")
        return self.done(node)

    def _unless_(self) -> Node:
        if self.language != "Ruby":
            return NotImplemented
        node = self.node("unless")
        self.take()
        self._ruby_if(node)
        node.test = None
        return node

    def _until_(self) -> Node:
        if self.language != "Ruby":
            return NotImplemented
        node = self._while_()
        node.kind, node.test = "until", None
        return node

    def _ruby_body(self, node: Node) -> None:
        """Statements up to the end that closes them, with rescue and ensure."""
        self.statements(node, ("end", "rescue", "ensure", "else"))
        while self.at("rescue", "ensure", "else"):
            self.take()
            self.statements(node, ("end", "rescue", "ensure", "else"))
        self.eat("end")

    def _ruby_tail(self, node: Node) -> Node:
        """Modifiers behind a statement: x if y."""
        while self.at("if", "unless", "while", "until", "rescue") and not self.tok.fresh:
            word = self.take().text
            test = self.expression()
            node = self.done(Node(f"{word}_modifier", node.s, node.e, "", [node, *([test] if test else [])]))
        return node

    # --- expressions ---

    def expression(self, least: int = 0, stop_in: bool = False, stop_arrow: bool = False) -> Node | None:
        left = self.operand()
        if left is None:
            return None
        while True:
            t = self.tok
            if t.kind == "end" or t.kind == "string" or t.kind == "number" or (t.fresh and self.how.lines and self.depth == 0 and not (self.language == "Ruby" and t.text in (".", "&."))):
                break
            if t.text in ("in", "of") and stop_in or t.text == "->" and stop_arrow:
                break
            op = t.text
            if t.kind == "name" and (op not in self.how.reserved or op in ("for", "if")) or op == "." and self.language != "PHP" or op == ":=" or op == "=>" and self.language not in ("PHP", "Ruby"):
                break
            if op == "=" and self.language == "Go":
                break
            binds = _BINDS.get(op, _ASSIGN if len(op) > 1 and op.endswith("=") and t.kind == "op" else None)
            if binds is None or binds <= least - (binds in (_ASSIGN, _TERNARY)) or self.language == "Go" and (binds == _ASSIGN and len(op) == 1 or op == "?"):
                break
            if op == "?" and self.language == "Go":
                break
            self.take()
            if op == "?":
                left = self._ternary(left)
                continue
            if self.language == "PHP" and op == "=" and self.at("&"):
                self.take()
            right = self.expression(binds)
            kind = "assign" if binds == _ASSIGN and op != "=>" else "logic" if op in ("&&", "||") else "compare" if op in ("==", "!=", "===", "!==") else "binary"
            left = self.done(Node(kind, left.s, left.e, op, [left, *([right] if right else [])], value=right if kind == "assign" else None))
        return left

    def _ternary(self, test: Node) -> Node:
        node = Node("ternary", test.s, test.e, "", [test], test=test)
        if self.language == "PHP" and self.at(":"):  # a ?: b
            node.kind, node.test = "binary", None
        else:
            a = self.expression(_ASSIGN)
            node.kids.extend([a] if a else [])
        self.eat(":")
        b = self.expression(_ASSIGN)
        node.kids.extend([b] if b else [])
        return self.done(node)

    def _brackets(self, kind: str) -> Node:
        """( ... ), [ ... ] or { ... }: what stands between commas."""
        node, end = self.node(kind), self.close_of(self.i)
        self.take()
        saved, brace, self.depth, self.no_brace = self.depth, self.no_brace, 1, False
        while self.i < end:
            before = self.i
            if self.language == "Javascript" and self.toks[end].text == "}" and (self.peek().text in ("(", ":") or self.at("get", "set", "async", "*", "[") and self.peek().text not in (",", "}")):
                part = self._js_member()
            elif self.language == "Javascript" and self.toks[end].text == "}" and self.word() and self.peek().text in (",", "}"):
                part = self.take() and None  # a shorthand property is no use of its name
            else:
                part = self.expression()
            node.kids.extend([part] if part else [])
            if self.i == before:
                self.take()
        self.skip_to(end)
        self.take()
        self.depth, self.no_brace = saved, brace
        return self.done(node)

    def _arrow(self, params: list[Node]) -> Node:
        """What follows => or ->: a body or an expression."""
        node = self.node("arrow")
        node.kids = params
        if self.at("{"):
            node.kids.append(self.block())
        else:
            body = self.expression(_ASSIGN)
            node.kids.extend([body] if body else [])
        return self.done(node)

    def operand(self) -> Node | None:
        t = self.tok
        if t.kind == "end":
            return None
        if t.kind in ("string", "number"):
            self.take()
            return self.postfix(Node("literal", t.s, t.e, t.text))
        if t.kind == "op":
            return self._operator_operand(t)
        text = t.text
        lower = text.lower() if self.language == "PHP" else text
        if lower in ("true", "false"):
            self.take()
            return self.postfix(Node("boolean", t.s, t.e, lower))
        if text in _LITERALS:
            self.take()
            return self.postfix(Node("literal", t.s, t.e, text))
        if text == "async" and self.peek().text in ("function", "(") or text == "async" and self.peek(2).text == "=>":
            self.take()
            return self.operand()
        if text == "function" and self.language in ("Javascript", "PHP") or text == "func" and self.language == "Go":
            return self._closure()
        if text == "static" and self.language == "PHP" and self.peek().text in ("function", "fn"):
            self.take()
            return self.operand()
        if text == "fn" and self.language == "PHP":
            self.take()
            params = self.parameters() if self.at("(") else []
            while self.tok.kind != "end" and not self.eat("=>"):
                self.take()
            return self._arrow(params)
        if text == "class" and self.language == "Javascript":
            found = self._class_()
            return found if isinstance(found, Node) else None
        if text == "new":
            return self._new()
        if text in ("typeof", "sizeof", "await", "yield", "delete", "not", "void", "clone", "throw", "include", "require", "print", "defined?", "co_await") and (text not in ("print", "delete", "clone", "include", "require", "void") or self.language in ("Javascript", "C++", "C", "PHP")) and self.peek().kind != "end":
            if text == "void" and self.language != "Javascript" or text == "print" and self.language != "PHP":
                pass
            else:
                node = self.node("unary", text)
                self.take()
                inner = self.expression(_UNARY)
                node.kids.extend([inner] if inner else [])
                return self.done(node)
        if self.language == "Ruby" and text in ("if", "unless", "case", "begin", "while", "until", "def"):
            found = getattr(self, f"_{text}_")()
            return found if isinstance(found, Node) else None
        if self.language == "Ruby" and text in ("lambda", "proc") and self.peek().text in ("{", "do"):
            self.take()
            return self._ruby_block("arrow")
        if text == "switch" and self.language == "Java" or text == "match" and self.language == "PHP" and self.peek().text == "(":
            return self._switch_()
        if text in self.how.reserved:
            return None
        if self.language == "Javascript" and self.peek().text == "=>":
            params = [self._param(self.take())]
            self.take()
            return self._arrow(params)
        if self.language == "Java" and self.peek().text == "->":
            params = [self._param(self.take())]
            self.take()
            return self._arrow(params)
        if self.language == "PHP" and not text.startswith("$"):
            self.take()
            return self.postfix(Node("word", t.s, t.e, text))
        if self.how.typed and self.language != "Java" and self.peek().text == "<":
            e = self.type_arguments(self.i + 1)
            if e is not None and self.toks[e].text in ("(", "::", "{"):
                self.i = e
                return self.postfix(Node("word", t.s, self.toks[e - 1].e, text))
        node = self.name_node()
        if self.language == "Ruby" and text[0] in "@$":
            node.kind = "word"
        return self.postfix(node)

    def _operator_operand(self, t: Token) -> Node | None:
        text = t.text
        if text == "!":
            node = self.node("not", "!")
            self.take()
            node.value = self.expression(_UNARY)
            node.kids.extend([node.value] if node.value else [])
            return self.done(node)
        if text in ("-", "+", "~", "&", "*", "++", "--", "...", "<-", "@", "&&", "**", "::", "\\", "#"):
            node = self.node("unary", text)
            self.take()
            inner = self.expression(_UNARY)
            node.kids.extend([inner] if inner else [])
            return self.done(node)
        if text == "(":
            end = self.close_of(self.i)
            after = self.toks[min(end + 1, len(self.toks) - 1)].text
            if after == "=>" and self.language == "Javascript" or after == "->" and self.language == "Java":
                params = self.parameters()
                if self.language == "Java" and not params:  # names without types
                    params = []
                self.take()
                return self._arrow(params)
            if self.how.typed and self._casts(end):
                node = self.node("cast")
                self.i = end + 1
                inner = self.expression(_UNARY)
                node.kids.extend([inner] if inner else [])
                return self.done(node)
            if self.language == "PHP" and end == self.i + 2 and self.peek().text in ("int", "bool", "string", "array", "float", "object", "boolean", "integer"):
                self.i = end + 1
                return self.expression(_UNARY)
            return self.postfix(self._brackets("paren"))
        if text == "[":
            end = self.close_of(self.i)
            if self.language in ("C++", "C") and self.toks[end + 1].text in ("(", "{"):
                node = self.node("arrow")
                self.i = end + 1
                if self.at("("):
                    node.kids.extend(self.parameters())
                while self.tok.kind != "end" and not self.at("{", ";", ")"):
                    self.take()
                if self.at("{"):
                    node.kids.append(self.block())
                return self.postfix(self.done(node))
            if self.language == "Go":  # []T{...} or []T(...)
                self.i = end + 1
                return self.operand() or self.node("word")
            return self.postfix(self._brackets("list"))
        if text == "{" and self.language != "PHP":
            return self.postfix(self._brackets("list"))
        if text == "->" and self.language == "Ruby":
            self.take()
            params = self.parameters() if self.at("(") else []
            node = self._ruby_block("arrow") if self.at("{", "do") else self.node("arrow")
            node.s, node.kids = t.s, params + node.kids
            return self.postfix(node)
        if text == "/" and self.language in ("Javascript", "Ruby"):  # a regular expression
            self.take()
            while self.tok.kind != "end" and not self.tok.fresh and not self.at("/"):
                self.take()
            self.eat("/")
            return self.postfix(self.done(Node("literal", t.s, t.e, "/")))
        return None

    def _casts(self, end: int) -> bool:
        """Whether ( ... ) up to ``end`` is a type before an operand."""
        j, after = self.type_end(self.i + 1), self.toks[min(end + 1, len(self.toks) - 1)]
        if j != end or after.kind == "end":
            return False
        primitive = self.peek().text in ("int", "long", "short", "char", "double", "float", "bool", "boolean", "byte", "unsigned", "const", "size_t", "void") or self.toks[end - 1].text in ("*", "&", ">")
        starts = after.kind in ("number", "string") or after.kind == "name" and after.text not in ("instanceof", "and", "or") or after.text in ("(", "!", "~")
        return starts and (primitive or after.text != "(" or self.language == "Java") or primitive and after.text in ("-", "+", "&", "*")

    def _closure(self) -> Node:
        node = self.node("closure")
        self.take()
        self.eat("*", "&")
        if self.language == "Go":
            if not self.at("("):
                return self.done(node)
            before = self.no_brace
            self.no_brace = False
            self._go_function(node)
            self.no_brace = before
            return self.postfix(node)
        if self.tok.kind == "name":
            self.take()
        if self.at("("):
            node.kids.extend(self.parameters())
        while self.tok.kind != "end" and not self.at("{", ";"):
            self.skip_to(self.close_of(self.i)) if self.at("(") else None
            self.take()
        if self.at("{"):
            node.kids.append(self.block())
        return self.postfix(self.done(node))

    def _new(self) -> Node:
        node = self.node("new")
        self.take()
        if self.language in ("Javascript", "PHP"):
            if self.at("class", "(", "["):
                inner = self.operand()
                node.kids.extend([inner] if inner else [])
            while self.tok.kind == "name" or self.at(".", "\\", "::"):
                self.take()
        else:
            if self.at("("):
                node.kids.append(self._brackets("list"))
            e = self.type_end(self.i)
            self.i = e if e is not None else self.i
        while self.at("[") and self.language in ("Java", "C++", "C"):
            node.kids.append(self._brackets("list"))
        if self.at("("):
            node.kids.append(self._brackets("list"))
        if self.at("{") and self.language in ("Java", "C++", "C"):
            node.kids.append(self.block("members", member=True) if self.language == "Java" and self.toks[self.i - 1].text == ")" else self._brackets("list"))
        return self.postfix(self.done(node))

    def _ruby_block(self, kind: str) -> Node:
        """{ |x| ... } or do |x| ... end."""
        node = self.node(kind)
        brace = self.take().text == "{"
        saved, self.depth, flag, self.no_brace = self.depth, 0, self.no_brace, False
        if self.eat("|"):
            while self.tok.kind != "end" and not self.eat("|"):
                if self.word():
                    node.kids.append(self._param(self.tok))
                self.take()
        elif self.at("||"):
            self.take()
        if brace:
            self.statements(node, ("}",))
            self.eat("}")
        else:
            self._ruby_body(node)
        self.depth, self.no_brace = saved, flag
        return self.done(node)

    def postfix(self, left: Node) -> Node:
        while True:
            t = self.tok
            if t.kind != "op" and not (self.language == "Ruby" and (t.text == "do" and not self.no_brace and left.kind in ("name", "call", "member") or self._command(left))):
                return left
            if t.fresh and self.how.lines and self.depth == 0 and not (self.language == "Ruby" and t.text in (".", "&.")):
                return left
            text = t.text
            if self.language == "Ruby" and self._command(left) and text != "(":
                args = Node("arguments", t.s, t.e)
                while (part := self.expression()) is not None:
                    args.kids.append(part)
                    if not self.eat(","):
                        break
                left = self.done(Node("call", left.s, left.e, "", [left, self.done(args)]))
            elif text == "(":
                args = self._brackets("arguments")
                if left.kind == "member" and self.how.member_names:  # one call node holds receiver, name and arguments
                    left = self.done(Node("call", left.s, left.e, "", [*left.kids, args]))
                else:
                    left = self.done(Node("call", left.s, left.e, "", [left, args]))
            elif text == "[":
                inside = self._brackets("list")
                left = self.done(Node("index", left.s, left.e, "", [left, *inside.kids]))
            elif text in (".", "->", "?.", "?->", "&.", "::") and not (text == "." and self.language == "PHP") and not (text == "->" and self.language in ("Java", "Ruby", "Go")):
                if text == "::" and self.language == "C++" and self.peek().kind == "name":
                    self.take()
                    left = self.done(Node("word", left.s, left.e, self.take().text))
                    continue
                if self.peek().text in ("(", "[") and text in (".", "?."):  # a type assertion; an optional call
                    self.take()
                    if self.language == "Go":
                        self.skip_to(self.close_of(self.i) + 1)
                        left = self.done(Node("assertion", left.s, left.e, "", [left]))
                    continue
                self.take()
                kids = [left]
                if self.tok.kind == "name":
                    name = self.name_node()
                    kids.extend([name] if self.how.member_names and name.text not in _LITERALS else [])
                    if self.language == "Ruby" and not self.at("("):
                        left = self.done(Node("call", left.s, left.e, "", kids))
                        continue
                elif self.at("{", "new", "<"):
                    self.skip_to(self.close_of(self.i) + 1 if self.at("{") else self.type_arguments(self.i) or self.i + 1)
                left = self.done(Node("member", left.s, left.e, text, kids))
            elif text in ("++", "--") and not (t.fresh and self.language == "Javascript"):
                self.take()
                left = self.done(Node("update", left.s, left.e, text, [left]))
            elif text == "{" and self.language == "Go" and not self.no_brace and left.kind in ("name", "member", "index"):
                inside = self._brackets("list")
                left = self.done(Node("composite", left.s, left.e, "", inside.kids))
            elif text == "{" and self.language == "C++" and left.kind == "word":
                left = self.done(Node("call", left.s, left.e, "", [self._brackets("arguments")]))
            elif self.language == "Ruby" and text in ("{", "do") and left.kind in ("name", "call", "member"):
                if text == "do" and self.no_brace:
                    return left
                block = self._ruby_block("braces" if text == "{" else "do_block")
                left = self.done(Node("call", left.s, left.e, "", [*(left.kids if left.kind == "call" else [left]), block]))
            else:
                return left

    def _command(self, left: Node) -> bool:
        """Ruby: whether arguments without brackets follow a name."""
        t = self.tok
        if t.fresh or t.s == left.e or left.kind not in ("name", "member") and not (left.kind == "call" and len(left.kids) and left.kids[-1].kind == "name"):
            return False
        if t.kind in ("string", "number"):
            return True
        return t.kind == "name" and t.text not in self.how.reserved or t.kind == "name" and t.text in ("not", "lambda", "proc") or t.text in ("[", "-", "*", "&", "::", ":", "!") and self.peek().s == t.e and t.text not in ("-", "*", "&")


# --- results ----------------------------------------------------------------------------------------


def parse(code: str | None, language: str) -> Node:
    """The root of a program's tree, alone if the program nests too deeply to be read. A language that is not in LANGUAGES raises."""
    if language not in LANGUAGES:
        raise ValueError(f"there is no grammar of {language}")
    try:
        return Parser(code or "", language).program()
    except RecursionError:
        return Node("program", 0, len(code or ""))


#: The kinds of functions whose insides belong to no function around them.
NESTED = {"Java": ("function",), "C++": ("function", "arrow"), "C": ("function", "arrow"), "Javascript": ("function", "arrow"), "PHP": ("function", "closure"), "Go": ("function", "closure"), "Ruby": ("function", "arrow", "braces")}


def outer_functions(root: Node, language: str) -> list[Node]:
    """The functions that own their insides, in the order of the text.

    Java, C++, C and PHP: those in no other function, at any depth; JavaScript: those of the program and
    of its classes; Go and Ruby: those of the program.
    """
    if language in ("Go", "Ruby"):
        return [n for n in root.kids if n.kind == "function" and n.text]
    if language == "Javascript":
        members = lambda n: [m for b in n.kids if b.kind == "members" for m in b.kids]
        return [f for n in root.kids for f in ([n] if n.kind == "function" else members(n) if n.kind == "class" else []) if f.kind == "function" and f.text]
    out, stack = [], [(n, False) for n in reversed(root.kids)]
    while stack:
        node, inside = stack.pop()
        if node.kind == "function" and not inside and node.text:
            out.append(node)
        stack.extend((k, inside or node.kind == "function" or node.kind == "arrow" and language in ("C++", "C")) for k in reversed(node.kids))
    return out


def own_nodes(function: Node, language: str) -> Iterator[tuple[Node, Node]]:
    """(node, parent) of a function in the order of the text, without what is inside of functions within."""
    stack = [(k, function) for k in reversed(function.kids)]
    while stack:
        node, parent = stack.pop()
        yield node, parent
        if node.kind not in NESTED[language]:
            stack.extend((k, node) for k in reversed(node.kids))


_NODE = T.StructType()
for _name, _kind in (("id", "integer"), ("parent", "integer"), ("kind", "string"), ("text", "string"), ("s", "integer"), ("e", "integer")):
    _NODE = _NODE.add(_name, _kind)


def node_rows(code: str | None, language: str) -> list[dict]:
    """The tree as rows: id (from 0, in the order of the text), parent (null for the root), kind, text, s and e in characters."""
    rows, stack = [], [(parse(code, language), None)]
    while stack:
        node, parent = stack.pop()
        rows.append({"id": len(rows), "parent": parent, "kind": node.kind, "text": node.text, "s": node.s, "e": node.e})
        stack.extend((k, len(rows) - 1) for k in reversed(node.kids))
    return rows


@F.pandas_udf(T.ArrayType(_NODE))
def tree_nodes(code: pd.Series, language: pd.Series) -> pd.Series:
    """Column form of :func:`node_rows`; null for languages without a grammar."""
    return pd.Series([node_rows(c, lang) if lang in LANGUAGES else None for c, lang in zip(code, language, strict=True)], dtype=object)


def program_nodes(programs: DataFrame, program: str = "problem_id") -> DataFrame:
    """A row for each node of each program (program, language, code)."""
    return programs.select(program, "language", F.explode(tree_nodes("code", "language")).alias("n")).select(program, "language", "n.*")
