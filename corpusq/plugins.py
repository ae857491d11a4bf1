"""Language rules, and the shapes of the callables a user can plug in.

encoder(texts) -> (dense vectors, sparse vectors)   used by ``operators.embedding``
scorer(queries, texts) -> scores                    used by ``operators.search.rerank``
completer(prompts) -> list of dicts                 used by ``operators.turns.complete``
"""

from __future__ import annotations

from dataclasses import dataclass, field


class LanguageError(ValueError):
    """A language is unknown, or its id or extension is already taken."""


@dataclass(frozen=True)
class OutlineRules:
    """How symbols and imports of a language are found; all patterns are Java regular expressions.

    ``style`` says where a body ends: "indent" or "braces". ``comments`` and ``strings`` are
    lexemes without groups, tried in this order at each place of the text. Heads are matched on
    lines without comments and strings; group 1 is the name. ``value_head`` is a declaration
    that is a symbol if its value is a function, which ``value_is_function`` sees on its line or
    an arrow shows later. ``not_method`` are lines that only look like ``method_head``.
    ``imports`` is "python", "es", or a pattern for one line whose group 1 is the module.
    """

    style: str
    comments: tuple[str, ...] = ()
    strings: tuple[str, ...] = ()
    class_head: str | None = None
    function_head: str | None = None
    value_head: str | None = None
    value_is_function: str | None = None
    method_head: str | None = None
    not_method: str | None = None
    imports: str | None = None


# Fixed patterns of lexemes and definition lines.
DOUBLE_QUOTED = r"\"[^\"\r\n\\]*+(?:\\[\r\n]++[^\"\r\n\\]*+)*+\"?"
SINGLE_QUOTED = r"'[^'\r\n\\]*+(?:\\[\r\n]++[^'\r\n\\]*+)*+'?"
PYTHON = OutlineRules(
    style="indent",
    comments=(r"#[^\r\n]*+",),
    strings=(r"\"\"\"[\s\S]*?(?:\"\"\"|\z)", r"'''[\s\S]*?(?:'''|\z)", DOUBLE_QUOTED, SINGLE_QUOTED),
    class_head=r"^\s*class\s+(\w+)",
    function_head=r"^\s*(?:async\s+)?def\s+(\w+)",
    imports="python",
)
ECMASCRIPT = OutlineRules(
    style="braces",
    comments=(r"//[^\r\n]*+", r"/\*[\s\S]*?(?:\*/|\z)"),
    strings=(
        # A template; its expressions may hold templates and braces once more.
        r"`[^`$]*+(?:\$(?:\{(?:[^{}`]++|`[^`]*+`|\{[^{}]*+\})*+\})?+[^`$]*+)*+`?",
        DOUBLE_QUOTED,
        SINGLE_QUOTED,
        # A regular expression, where a division cannot stand; the slash is looked for before what is left of it.
        r"(?=/)(?<=(?:[(,=:\[!&|?{};]|\breturn)\s{0,8})/(?![*/])(?:[^/\r\n\[]|\[[^\]\r\n]*+\])++/[a-z]*+",
    ),
    class_head=r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+([\w$]+)",
    function_head=r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)",
    value_head=r"^\s*(?:export\s+)?(?:declare\s+)?(?:const|let|var)\s+([\w$]+)",
    value_is_function=(
        r"^[^=]*?(?::[^=]+?(?:=>[^=]+?)?)?=\s*(?:async\b\s*)?"
        r"(?:function\b|(?:<[^>]*>\s*)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::\s*[^=]+)?=>|[\w$]+\s*=>)"
    ),
    method_head=(
        r"^\s*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*"
        r"[*#]?([\w$]+|\[[\w$.]+\])\s*(?:<[^>(]*>)?\("
    ),
    not_method=r"^\s*(?:if|for|while|switch|catch|function|return|with|do|else|await|new|throw|typeof|super|this)\b",
    imports="es",
)
STYLES = {"indent": PYTHON, "braces": ECMASCRIPT}


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    interpreters: tuple[str, ...] = ()
    outline: str | OutlineRules | None = None  # own rules, or those of a built-in style: "indent", "braces"

    def __post_init__(self) -> None:
        if isinstance(self.outline, str) and self.outline not in STYLES:
            raise LanguageError(f"unknown outline style {self.outline!r}")


@dataclass
class LanguageRegistry:
    languages: dict[str, Language] = field(default_factory=dict)

    def register(self, language: Language) -> Language:
        if language.name in self.languages:
            raise LanguageError(f"language {language.name!r} is already registered")
        for extension in language.extensions:
            owner = self.by_extension(extension)
            if owner is not None:
                raise LanguageError(f"extension {extension!r} belongs to {owner.name!r}")
        self.languages[language.name] = language
        return language

    def get(self, name: str) -> Language:
        if name not in self.languages:
            raise LanguageError(f"unknown language {name!r}")
        return self.languages[name]

    def by_extension(self, extension: str) -> Language | None:
        return next((x for x in self.languages.values() if extension in x.extensions), None)

    def extension_map(self) -> dict[str, str]:
        return {e: x.name for x in self.languages.values() for e in x.extensions}

    def interpreter_map(self) -> dict[str, str]:
        return {i: x.name for x in self.languages.values() for i in x.interpreters}

    def outlines(self) -> list[tuple[OutlineRules, list[str]]]:
        """Rules, each with the languages that follow them."""
        found: dict[OutlineRules, list[str]] = {}
        for x in self.languages.values():
            if x.outline is not None:
                rules = STYLES[x.outline] if isinstance(x.outline, str) else x.outline
                found.setdefault(rules, []).append(x.name)
        return list(found.items())


def default_registry() -> LanguageRegistry:
    """The built-in languages, their extensions and interpreters."""
    registry = LanguageRegistry()
    registry.register(Language("python", (".py",), ("python", "python3"), "indent"))
    registry.register(Language("javascript", (".js", ".jsx"), ("node",), "braces"))
    registry.register(Language("typescript", (".ts", ".tsx"), (), "braces"))
    registry.register(Language("go", (".go",)))
    registry.register(Language("java", (".java",)))
    return registry


REGISTRY = default_registry()


def register_language(
    name: str,
    extensions: tuple[str, ...],
    interpreters: tuple[str, ...] = (),
    outline: str | OutlineRules | None = None,
) -> Language:
    return REGISTRY.register(Language(name, tuple(extensions), tuple(interpreters), outline))
