"""Symbols, imports and change history from source text.

There is no syntax tree here. First strings and comments are blanked over the whole text, also those
that span lines; then a fold over the lines keeps the depth of brackets and braces, so that headers,
statements and bodies may span lines. Python blocks end where the indent falls back, blocks of
brace languages where the braces close. What cannot be told without a grammar stays open: an
apostrophe in JSX text reads as a string to the end of its line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.functions.spans import split_lines
from corpusq.functions.text import let
from corpusq.plugins import REGISTRY, LanguageRegistry, OutlineRules
from corpusq.session import inline_rows

SYMBOL = "struct<start_line:int,end_line:int,kind:string,name:string,depth:int>"
OPEN = "struct<start_line:int,mark:int,kind:string,name:string,depth:int>"
# A header or body in which nothing else is looked for.
HELD = (
    "struct<start_line:int,mark:int,around:int,kind:string,name:string,depth:int,opened:boolean,is_value:boolean,"
    "counts:boolean>"
)
# Stands for a string, and at the start of a line for the rest of a string that began above.
STRING, INSIDE = "\u0001", "\u0002"
# Stands before and after a lexeme while a text is cut.
MARK = "\u0003"
# Ends of lines after which a statement goes on, and starts that go on from the line before.
GOES_ON = r"(?:=>|[-=(\[{,+*/%&|^?:.<>!~])\s*$"
FROM_ABOVE = r"^\s*[-.?:+*/%&|^=,)\]}<>{]"


def blanked(text: Column, rules: OutlineRules) -> Column:
    """The text without comments, each string a placeholder; line ends stay where they are.

    Escaped characters are made harmless first, so that a string ends at the next quote. All
    lexemes are found in one scan, left to right: what is inside one cannot start another.
    """
    lexeme = "|".join([*rules.comments, *rules.strings])
    if not lexeme:
        return text
    comment = "^(?:" + "|".join(rules.comments) + ")$" if rules.comments else r"(?!)"

    def blank(part: Column) -> Column:
        ends = F.when(part.rlike(r"[\r\n]"), F.regexp_replace(part, r"[^\r\n]+", "")).otherwise(F.lit(""))
        in_string = F.concat(F.lit(STRING), F.regexp_replace(ends, r"(\r\n|\n|\r)", "$1" + INSIDE))
        # A comment counts as a space where it stood between words.
        return F.when(part.rlike(comment), F.concat(F.lit(" "), ends)).otherwise(in_string)

    def rebuilt(plain: Column) -> Column:
        # Lexemes are every second part of the text cut at marks; a text that holds the mark is scanned twice.
        marked = F.split(F.regexp_replace(plain, f"({lexeme})", f"{MARK}$1{MARK}"), MARK, -1)
        twice = let(
            F.regexp_extract_all(plain, F.lit(f"({lexeme})"), F.lit(1)),
            lambda parts: F.flatten(
                F.transform(F.split(plain, lexeme, -1), lambda code, n: F.array(code, F.coalesce(F.get(parts, n), F.lit(""))))
            ),
        )
        cut = F.when(F.contains(plain, F.lit(MARK)), twice).otherwise(marked)
        return F.array_join(F.transform(cut, lambda part, n: F.when((n % 2 == 1) & (part != ""), blank(part)).otherwise(part)), "")

    return let(F.regexp_replace(text, r"\\[^\r\n]", "__"), rebuilt)


def _turn(line: Column, opening: str, closing: str) -> Column:
    """How many more ``opening`` than ``closing`` characters, all ASCII, a line has; most lines have none."""

    def without(characters: str) -> Column:
        return F.octet_length(F.translate(line, characters, ""))

    some = F.lit("[" + "".join(f"\\{c}" for c in opening + closing) + "]")
    return F.when(F.rlike(line, some), without(closing) - without(opening)).otherwise(F.lit(0))


def _closed(stack: Column, end: Column, gone) -> Column:
    return F.transform(
        F.filter(stack, gone),
        lambda s: F.struct(
            s["start_line"].alias("start_line"),
            end.cast("int").alias("end_line"),
            s["kind"].alias("kind"),
            s["name"].alias("name"),
            s["depth"].alias("depth"),
        ),
    )


def _name(line: Column, pattern: str | None) -> Column:
    if pattern is None:
        return F.lit(None).cast("string")
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))


def _opened(start: Column, mark: Column, kind: Column, name: Column, stack: Column) -> Column:
    return F.array(
        F.struct(
            start.cast("int").alias("start_line"),
            mark.cast("int").alias("mark"),
            kind.alias("kind"),
            name.alias("name"),
            F.size(stack).cast("int").alias("depth"),
        )
    ).cast(f"array<{OPEN}>")


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _lines_of_code(lines: Column, rules: OutlineRules) -> Column:
    """Lines of the blanked text. A last line that was only a comment may be blank."""
    return split_lines(blanked(F.array_join(lines, ""), rules))


def indent_symbols(lines: Column, rules: OutlineRules) -> Column:
    """Python-like symbols. A function body is not searched further.

    A line inside brackets, inside a string, or after a backslash belongs to the statement
    above: its indent says nothing, but it moves the end of what is open.
    """
    code = F.transform(
        _lines_of_code(lines, rules),
        lambda line, n: F.struct(
            (n + 1).alias("n"),
            F.length(F.regexp_extract(line, r"^([ \t]*)", 1)).alias("indent"),
            _name(line, rules.class_head).alias("class_name"),
            _name(line, rules.function_head).alias("function_name"),
            line.rlike(r"\S").alias("is_code"),
            F.startswith(line, F.lit(INSIDE)).alias("inside"),
            line.rlike(r"\\\s*$").alias("goes_on"),
            _turn(line, "([{", ")]}").alias("turn"),
        ),
    )
    start = F.struct(
        _none(OPEN).alias("stack"),
        _none(SYMBOL).alias("out"),
        F.lit(0).alias("last"),
        F.lit(0).alias("brackets"),
        F.lit(False).alias("goes_on"),
    )

    def step(acc: Column, c: Column) -> Column:
        def state(stack: Column, out: Column) -> Column:
            return F.struct(
                stack.alias("stack"),
                out.alias("out"),
                c["n"].alias("last"),
                F.greatest(acc["brackets"] + c["turn"], F.lit(0)).alias("brackets"),
                c["goes_on"].alias("goes_on"),
            )

        def then(kept: Column) -> Column:
            inside_function = F.exists(kept, lambda s: s["kind"] != "class")
            name = F.coalesce(c["class_name"], c["function_name"])
            kind = (
                F.when(c["class_name"].isNotNull(), F.lit("class"))
                .when(F.size(kept) > 0, F.lit("method"))
                .otherwise(F.lit("function"))
            )
            return state(
                F.when(
                    name.isNotNull() & ~inside_function,
                    F.concat(kept, _opened(c["n"], c["indent"], kind, name, kept)),
                ).otherwise(kept),
                F.when(
                    F.size(kept) < F.size(acc["stack"]),
                    F.concat(acc["out"], _closed(acc["stack"], acc["last"], lambda s: s["mark"] >= c["indent"])),
                ).otherwise(acc["out"]),
            )

        continued = c["inside"] | (acc["brackets"] > 0) | acc["goes_on"]
        return (
            F.when(~c["is_code"], acc)
            .when(continued, state(acc["stack"], acc["out"]))
            .otherwise(let(F.filter(acc["stack"], lambda s: s["mark"] < c["indent"]), then))
        )

    return F.sort_array(
        F.aggregate(
            code,
            start,
            step,
            lambda acc: F.concat(acc["out"], _closed(acc["stack"], acc["last"], lambda s: F.lit(True))),
        )
    )


def _braces(line: Column) -> Column:
    """Where a line's braces lead: after it, and at the lowest and highest point within."""

    def led(after: int, low: int, high: int) -> Column:
        return F.struct(F.lit(after).alias("after"), F.lit(low).alias("low"), F.lit(high).alias("high"))

    zero = led(0, 0, 0)

    def step(acc: Column, sign: Column) -> Column:
        now = acc["after"] + F.when(sign == "{", 1).when(sign == "}", -1).otherwise(0)
        return F.struct(
            now.alias("after"), F.least(acc["low"], now).alias("low"), F.greatest(acc["high"], now).alias("high")
        )

    def walked(signs: Column) -> Column:
        one = F.when(signs == "{", led(1, 0, 1)).when(signs == "}", led(-1, -1, 0))
        return one.otherwise(F.aggregate(F.split(signs, ""), zero, step))

    return F.when(line.rlike("[{}]"), let(F.regexp_replace(line, r"[^{}]+", ""), walked)).otherwise(zero)


def brace_symbols(lines: Column, rules: OutlineRules) -> Column:
    """JavaScript-like symbols. Only classes are searched further.

    A header waits for its brace over as many lines as it takes, and is dropped if its statement
    ends before. A declared value is a symbol if it is a function; it ends with its statement.
    """
    no = F.lit(False)

    def about(line: Column, n: Column, ls: Column) -> Column:
        following = F.get(ls, n + 1)
        looks_like = ~line.rlike(rules.not_method) if rules.not_method else F.lit(True)
        # Asked of declared values only.
        is_function = F.when(line.rlike(rules.value_head), line.rlike(rules.value_is_function)).otherwise(no) if (
            rules.value_head and rules.value_is_function
        ) else no
        return F.struct(
            (n + 1).alias("n"),
            _braces(line).alias("b"),
            line.rlike("[{}]").alias("has_brace"),
            _turn(line, "([", ")]").alias("turn"),
            _name(line, rules.class_head).alias("class_name"),
            _name(line, rules.function_head).alias("function_name"),
            _name(line, rules.value_head).alias("value_name"),
            is_function.alias("is_function"),
            (line.rlike(r"\)\s*(?::[^={]*)?=>") if rules.value_head else no).alias("arrow"),
            F.when(looks_like, _name(line, rules.method_head)).alias("method_name"),
            line.rlike(r"\S").alias("is_code"),
            F.startswith(line, F.lit(INSIDE)).alias("inside"),
            (line.rlike(GOES_ON) | F.coalesce(following.rlike(FROM_ABOVE), no)).alias("goes_on"),
            line.rlike(r";\s*$").alias("ends"),
            F.coalesce(following.rlike(r"^\s*\{"), no).alias("brace_next"),
        )

    start = F.struct(
        _none(OPEN).alias("classes"),
        F.lit(None).cast(HELD).alias("held"),
        _none(SYMBOL).alias("ended"),
        F.lit(0).alias("depth"),
        F.lit(0).alias("around"),
    )

    def step(whole: Column, c: Column) -> Column:
        # What a line ends is added to all others at the next line, outside of any bound value: these are copied.
        return F.struct(following(whole["now"], c).alias("now"), _added(whole).alias("out"))

    def _added(whole: Column) -> Column:
        ended = whole["now"]["ended"]
        return F.when(F.size(ended) > 0, F.concat(whole["out"], ended)).otherwise(whole["out"])

    def following(acc: Column, c: Column) -> Column:
        depth, around, classes = acc["depth"], acc["around"], acc["classes"]
        after, round_after = depth + c["b"]["after"], around + c["turn"]
        low, high = depth + c["b"]["low"], depth + c["b"]["high"]
        is_member = F.coalesce(F.try_element_at(classes, F.lit(-1))["mark"] + 1 == depth, no)
        kind = (
            F.when(c["function_name"].isNotNull(), F.lit("function"))
            .when(c["value_name"].isNull() | (F.size(classes) > 0), F.lit("method"))
            .otherwise(F.lit("function"))
        )
        # A name before a list and a brace is a method anywhere; in a class the brace may come later.
        method = F.when(is_member | (c["b"]["high"] > 0), c["method_name"])
        name = F.coalesce(c["function_name"], c["value_name"], method)
        begun = F.when(
            name.isNotNull() & c["class_name"].isNull() & ~c["inside"],
            F.struct(
                c["n"].alias("start_line"), depth.alias("mark"), around.alias("around"), kind.alias("kind"), name.alias("name"),
                F.size(classes).alias("depth"), no.alias("opened"), c["value_name"].isNotNull().alias("is_value"),
                F.when(c["value_name"].isNull() | c["is_function"], F.lit(True)).alias("counts"),
            ).cast(HELD),
        )

        def then(held: Column) -> Column:
            fresh = acc["held"].isNull()
            # Braces of a type before the body are none of the body.
            opened = held["opened"] | ((high > held["mark"]) & ~((after <= held["mark"]) & c["brace_next"]))
            balanced = round_after <= held["around"]
            # Where the list of parameters has closed on a later line, an arrow must follow it.
            counts = F.coalesce(held["counts"], F.when(balanced & ~fresh & c["arrow"], F.lit(True)))
            fallen = F.when(held["opened"], low <= held["mark"]).otherwise(after <= held["mark"])
            stays = F.when(
                held["is_value"], ~((after <= held["mark"]) & balanced & (c["ends"] | ~c["goes_on"]))
            ).otherwise(~(opened & fallen) & ~(~opened & balanced & (c["ends"] | ~(c["goes_on"] | c["brace_next"]))))
            complete = held.isNotNull() & ~stays & (held["is_value"] | opened) & F.coalesce(counts, no)
            symbol = F.array(
                F.struct(
                    held["start_line"].alias("start_line"), c["n"].cast("int").alias("end_line"),
                    held["kind"].alias("kind"), held["name"].alias("name"), held["depth"].alias("depth"),
                )
            ).cast(f"array<{SYMBOL}>")
            new_class = F.when(
                held.isNull() & c["class_name"].isNotNull() & ~c["inside"],
                _opened(c["n"], depth, F.lit("class"), c["class_name"], classes),
            ).otherwise(_none(OPEN))

            # A class of one line opens and falls at once; one without its brace yet waits for it.
            def falls(s: Column) -> Column:
                return F.when(s["start_line"] == c["n"], (high > s["mark"]) & (after <= s["mark"])).otherwise(
                    (low <= s["mark"]) & ((depth > s["mark"]) | ((high > s["mark"]) & (after <= s["mark"])))
                )

            def state(all_classes: Column) -> Column:
                fallen_ones = F.exists(all_classes, falls)
                return F.struct(
                    F.when(fallen_ones, F.filter(all_classes, lambda s: ~falls(s))).otherwise(all_classes).alias("classes"),
                    F.when(
                        held.isNotNull() & stays,
                        F.struct(
                            *[held[f].alias(f) for f in ("start_line", "mark", "around", "kind", "name", "depth")],
                            opened.alias("opened"), held["is_value"].alias("is_value"), counts.alias("counts"),
                        ).cast(HELD),
                    ).alias("held"),
                    F.concat(
                        F.when(complete, symbol).otherwise(_none(SYMBOL)),
                        F.when(fallen_ones, _closed(all_classes, c["n"], falls)).otherwise(_none(SYMBOL)),
                    ).alias("ended"),
                    after.alias("depth"),
                    round_after.alias("around"),
                )

            return let(F.concat(classes, new_class), state)

        # A line without braces changes nothing but the round and square brackets if it begins nothing
        # outside of a body, or lies in the open body of what is not a value.
        begins = c["class_name"].isNotNull() | c["function_name"].isNotNull() | c["value_name"].isNotNull() | c["method_name"].isNotNull()
        quiet = ~c["has_brace"] & F.when(acc["held"].isNull(), ~begins).otherwise(acc["held"]["opened"] & ~acc["held"]["is_value"])
        passed = F.when((c["turn"] == 0) & (F.size(acc["ended"]) == 0), acc).otherwise(
            F.struct(
                classes.alias("classes"), acc["held"].alias("held"), _none(SYMBOL).alias("ended"), depth.alias("depth"),
                round_after.alias("around"),
            )
        )
        return F.when(~c["is_code"] | quiet, passed).otherwise(let(F.coalesce(acc["held"], begun), then))

    def finish(whole: Column) -> Column:
        # What is still open when the text ends reaches to its last line.
        acc = whole["now"]
        held = acc["held"]
        left = F.when(
            held.isNotNull() & (held["opened"] | held["is_value"]) & F.coalesce(held["counts"], no), F.array(held)
        ).otherwise(_none(HELD))
        return F.concat(
            _added(whole),
            _closed(left, F.size(lines), lambda s: F.lit(True)),
            _closed(acc["classes"], F.size(lines), lambda s: F.lit(True)),
        )

    return let(
        _lines_of_code(lines, rules),
        lambda ls: F.sort_array(F.aggregate(
            F.transform(ls, lambda line, n: about(line, n, ls)), F.struct(start.alias("now"), _none(SYMBOL).alias("out")), step, finish
        )),
    )


def symbols_of(lines: Column, language: Column, registry: LanguageRegistry = REGISTRY) -> Column:
    """Array of (start_line, end_line, kind, name, depth) of one file, by the rules of its language."""
    found = _none(SYMBOL)
    for rules, names in registry.outlines():
        fold = indent_symbols if rules.style == "indent" else brace_symbols
        found = F.when(language.isin(*names), fold(lines, rules)).otherwise(found)
    return found


def symbol_outline(
    files: DataFrame, text: str = "content", registry: LanguageRegistry = REGISTRY
) -> DataFrame:
    """Adds ``symbols``: array of (start_line, end_line, kind, name, depth) per file."""
    return files.withColumn(
        "symbols",
        let(split_lines(F.col(text)), lambda ls: symbols_of(ls, F.col("language"), registry)),
    )


# --- imports ----------------------------------------------------------------------

IMPORT = "array<struct<module:string,names:array<string>,line:int>>"


def _one(module: Column, names: Column, n: Column) -> Column:
    return F.struct(
        module.alias("module"), names.cast("array<string>").alias("names"), n.cast("int").alias("line")
    )


def _local_names(list_text: Column) -> Column:
    """``a, b as c`` -> [a, c]; ``*`` stays."""
    parts = F.split(F.regexp_replace(list_text, r"[(){}]", " "), ",")
    names = F.transform(
        parts,
        lambda p: F.regexp_replace(F.trim(F.regexp_replace(p, r"\s+", " ")), r"^.* as ", ""),
    )
    return F.filter(names, lambda n: n != "")


def _until(ends: Column, n: Column) -> Column:
    """First of the ascending line numbers ``ends`` at or after ``n``."""
    return F.coalesce(F.get(ends, lower_bound(ends, n)), n)


def _join(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first + 1, last - first + 1), "")


# Simple statements end at a semicolon or a line; these lines hold a block instead.
PY_BLOCK = r"^(?:if|elif|else|for|while|with|try|except|finally|class|def|async|match|case)\b"


def _statement_starts(code: Column) -> Column:
    """Numbers (from 0) of the lines on which a Python statement starts."""
    turns = F.transform(
        code,
        lambda line: F.struct(
            _turn(line, "([{", ")]}").alias("turn"),
            line.rlike(r"\\\s*$").alias("goes_on"),
            F.startswith(line, F.lit(INSIDE)).alias("inside"),
        ),
    )
    start = F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("brackets"), F.lit(False).alias("goes_on"), _none("int").alias("starts")
    )

    def step(acc: Column, t: Column) -> Column:
        continued = t["inside"] | (acc["brackets"] > 0) | acc["goes_on"]
        return F.struct(
            (acc["n"] + 1).alias("n"),
            F.greatest(acc["brackets"] + t["turn"], F.lit(0)).alias("brackets"),
            t["goes_on"].alias("goes_on"),
            F.when(continued, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["n"]))).alias("starts"),
        )

    return F.aggregate(turns, start, step, lambda acc: acc["starts"])


def python_imports(lines: Column, rules: OutlineRules) -> Column:
    """Imports at the top level, several of one line too; relative modules keep their dots."""

    def parse(plain: Column, n: Column) -> Column:
        modules = F.transform(
            F.split(F.regexp_extract(plain, r"^import\s+([\s\S]*)", 1), ","),
            lambda m: F.regexp_extract(m, r"^\s*([\w.]+)", 1),
        )
        head = r"^from\s*([\w.\s]*?)\s*\bimport\b"
        from_module = F.regexp_replace(F.regexp_extract(plain, head, 1), r"\s", "")
        imported = F.regexp_extract(plain, head + r"\s*([\s\S]*)", 2)
        return (
            F.when(
                plain.rlike(r"^import\s"),
                F.transform(F.filter(modules, lambda m: m != ""), lambda m: _one(m, F.array().cast("array<string>"), n + 1)),
            )
            .when(plain.rlike(head), F.array(_one(from_module, _local_names(imported), n + 1)))
            .otherwise(F.array().cast(IMPORT))
        )

    def found(code: Column) -> Column:
        def edges(starts: Column) -> Column:
            def of_line(t: Column) -> Column:
                last = F.coalesce(F.get(starts, t["k"] + 1), F.size(code)) - 1
                whole = F.regexp_replace(_join(code, t["first"], last), r"\\\s*[\r\n]+", " ")
                parts = F.transform(F.split(whole, ";"), lambda x: F.regexp_replace(x, r"^\s+", ""))
                return F.flatten(F.transform(parts, lambda part: parse(part, t["first"])))

            def may_import(t: Column) -> Column:
                line = F.get(code, t["first"])
                return line.rlike(r"^\S") & line.rlike(r"\b(?:import|from)\b") & ~line.rlike(PY_BLOCK)

            tops = F.transform(starts, lambda first, k: F.struct(first.alias("first"), k.alias("k")))
            return F.flatten(F.transform(F.filter(tops, may_import), of_line))

        return let(_statement_starts(code), edges)

    return F.coalesce(let(_lines_of_code(lines, rules), found), F.array()).cast(IMPORT)


IMPORT_START = r"(?:^|;)\s*import\b\s*[^(.\s]"
ES_IMPORT = (
    r"\bimport\b\s*(?:type\s+(?!from\b))?([\w$*{}\s,]*?)\s*(?:\bfrom\s*)?"
    r"(?:'([^'\r\n]*)'|\"([^\"\r\n]*)\")"
)


def es_imports(lines: Column, rules: OutlineRules) -> Column:
    """ES module imports: default, namespace and named, by local name; several of one line too."""

    def found(code: Column, text: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(code) - 1)
        holds_string = F.filter(numbers, lambda n: F.contains(F.get(code, n), F.lit(STRING)))
        starts = F.filter(numbers, lambda n: F.contains(F.get(code, n), F.lit("import")) & F.get(code, n).rlike(IMPORT_START))

        def names(clause: Column) -> Column:
            bare = F.regexp_replace(clause, r"\*\s+as\s+", "")
            return _local_names(F.regexp_replace(bare, r"\btype\s+(?=[\w$])", ""))

        def edges(n: Column, strings: Column) -> Column:
            # The module's name ends the statement: the first string from here on.
            whole = _join(text, n, _until(strings, n))
            clause, single, double = (F.regexp_extract_all(whole, F.lit(ES_IMPORT), F.lit(g)) for g in (1, 2, 3))
            found = F.arrays_zip(clause.alias("clause"), single.alias("single"), double.alias("double"))
            return F.slice(
                F.transform(found, lambda x: _one(F.concat(x["single"], x["double"]), names(x["clause"]), n + 1)),
                F.lit(1),
                F.regexp_count(F.get(code, n), F.lit(IMPORT_START)),
            )

        # Bound, as each step of each statement's search would find the lines with strings again.
        found_edges = let(holds_string, lambda strings: F.flatten(F.transform(starts, lambda n: edges(n, strings))))
        return F.when(F.size(code) > 0, found_edges)

    def body(whole: Column) -> Column:
        # Comments beside the names go; strings stay, as the modules are read from them.
        bare = F.regexp_replace(F.regexp_replace(whole, r"/\*[^\r\n]*?\*/", " "), r"(?<=[;,}{\s])//[^\r\n]*", " ")
        return let(split_lines(blanked(whole, rules)), lambda code: let(split_lines(bare), lambda text: found(code, text)))

    return F.coalesce(let(F.array_join(lines, ""), body), F.array()).cast(IMPORT)


def line_imports(lines: Column, rules: OutlineRules) -> Column:
    """Imports by a pattern for one line, in lines that do not lie in a comment or string."""

    def found(code: Column) -> Column:
        edges = F.transform(
            lines,
            lambda line, n: _one(
                F.when(F.get(code, n).rlike(r"^\s*\w"), F.regexp_extract(line, rules.imports, 1)).otherwise(F.lit("")),
                F.array().cast("array<string>"),
                n + 1,
            ),
        )
        return F.filter(edges, lambda e: e["module"] != "")

    return F.coalesce(let(_lines_of_code(lines, rules), found), F.array()).cast(IMPORT)


def imports_of(text: Column, language: Column, registry: LanguageRegistry = REGISTRY) -> Column:
    """Array of (module, names, line) of one file; null for languages without a rule for imports."""
    kinds = {"python": python_imports, "es": es_imports}

    def body(ls: Column) -> Column:
        found = F.lit(None).cast(IMPORT)
        for rules, names in registry.outlines():
            if rules.imports:
                found = F.when(language.isin(*names), kinds.get(rules.imports, line_imports)(ls, rules)).otherwise(found)
        return found

    return let(split_lines(text), body)


def import_edges(
    files: DataFrame, text: str = "content", registry: LanguageRegistry = REGISTRY
) -> DataFrame:
    """One row per import: file_id, module, names, line."""
    return inline_rows(files, ["file_id"], imports_of(F.col(text), F.col("language"), registry), "line")


def file_imports(edges: DataFrame) -> DataFrame:
    """Modules of each file in line order: (file_id, modules)."""
    return edges.groupBy("file_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("line", "module"))), lambda e: e["module"]).alias(
            "modules"
        )
    )


def symbol_references(edges: DataFrame) -> DataFrame:
    """How many files import each module, counted before any shuffle of whole rows."""
    return edges.select("module", "file_id").distinct().groupBy("module").agg(
        F.count(F.lit(1)).alias("files")
    )


# --- history ----------------------------------------------------------------------

def parse_blame(dumps: DataFrame, text: str = "porcelain") -> DataFrame:
    """Line-porcelain text -> one row per source line: author, commit_sha, committed_at.

    A record ends at its tab line and counts only if commit, author and time were
    all seen since the last tab line. Each dump is one row, so records are cut
    inside the row.
    """
    others = [c for c in dumps.columns if c != text]
    records = F.split(F.col(text), r"(?m)^\t.*$")

    def record(part: Column) -> Column:
        # The text after the last tab line is no record; values seen last win.
        return F.struct(
            F.regexp_extract(part, r"(?ms).*^([0-9a-f]{40}) \d+ \d+", 1).alias("commit_sha"),
            F.regexp_extract(part, r"(?ms).*^author ([^\n]*)", 1).alias("author"),
            part.rlike(r"(?m)^author ").alias("has_author"),
            F.regexp_extract(part, r"(?ms).*^author-time (\d+)", 1).alias("author_time"),
        )

    parsed = F.transform(F.slice(records, F.lit(1), F.size(records) - 1), record)
    rows = dumps.select(*others, F.posexplode_outer(parsed).alias("pos", "r")).where(
        "r.commit_sha <> '' AND r.has_author AND r.author_time <> ''"
    )
    return rows.select(
        *others,
        (F.col("pos") + 1).alias("line_no"),
        F.col("r.author").alias("author"),
        F.col("r.commit_sha").alias("commit_sha"),
        F.timestamp_seconds(F.col("r.author_time").cast("long")).alias("committed_at"),
    )


BLAME = ["line_no", "author", "commit_sha", "committed_at"]


def lower_bound(numbers: Column, value: Column) -> Column:
    """How many of the ascending ``numbers`` are below ``value``: a binary search inside the row."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(numbers) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(numbers).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        below = (acc["low"] < acc["high"]) & (F.get(numbers, middle) < value)
        return F.struct(
            F.when(below, middle + 1).otherwise(acc["low"]).alias("low"),
            F.when(below | (acc["low"] >= acc["high"]), acc["high"]).otherwise(middle).alias("high"),
        )

    return F.aggregate(steps, start, halve, lambda acc: acc["low"])


def _spans_with_blame(spans: DataFrame, blame_lines: DataFrame) -> DataFrame:
    """One row per file: its spans, each with the blame entries of its lines.

    Spans and lines of a file meet once, as two arrays of one row; each span then finds its
    stretch of the sorted lines by two binary searches. Files without blame keep their spans.
    """
    lines = blame_lines.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct(*BLAME))).alias("lines"))
    lines = lines.withColumn("numbers", F.transform("lines", lambda e: e["line_no"]))
    grouped = spans.groupBy("file_id").agg(F.collect_list(F.struct(*spans.columns)).alias("spans"))

    def with_entries(s: Column) -> Column:
        numbers = F.coalesce("numbers", F.array().cast("array<int>"))
        found = let(
            F.struct(
                lower_bound(numbers, s["start_line"]).alias("first"), lower_bound(numbers, s["end_line"] + 1).alias("stop")
            ),
            lambda r: F.slice("lines", r["first"] + 1, F.greatest(r["stop"] - r["first"], F.lit(0))),
        )
        known = F.col("lines").isNotNull() & s["start_line"].isNotNull() & s["end_line"].isNotNull()
        return F.struct(*[s[c].alias(c) for c in spans.columns], F.when(known, found).alias("entries"))

    return grouped.join(lines, "file_id", "left").select(F.transform("spans", with_entries).alias("spans"))


def blame_for_spans(spans: DataFrame, blame_lines: DataFrame) -> DataFrame:
    """One row per span and blame entry whose line lies in it."""
    found = _spans_with_blame(spans, blame_lines).select(F.inline("spans"))
    return found.select(*spans.columns, F.inline("entries"))


def symbol_metadata(symbols: DataFrame, edges: DataFrame, blame_lines: DataFrame) -> DataFrame:
    """Every symbol with its file's import modules and its own range's blame entries.

    A symbol without any has null in ``blame``.
    """
    found = _spans_with_blame(symbols, blame_lines).select(F.inline("spans"))
    entries = F.transform("entries", lambda e: F.struct(*[e[c].alias(c) for c in BLAME[1:]]))
    return found.select(*symbols.columns, F.when(F.size("entries") > 0, entries).alias("blame")).join(
        file_imports(edges), "file_id", "left"
    )


def format_blame(spans: DataFrame) -> DataFrame:
    """``path:start-end`` then one ``sha8 author date`` line per blame entry."""
    line = F.concat_ws(
        " ",
        F.substring("commit_sha", 1, 8),
        F.col("author"),
        F.date_format("committed_at", "yyyy-MM-dd"),
    )
    return (
        spans.withColumn("line", line)
        .groupBy("file_id", "file_path", "start_line", "end_line")
        .agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("entries"))
        .select(
            "file_id",
            "start_line",
            "end_line",
            F.concat(
                F.format_string("%s:%d-%d\n", "file_path", "start_line", "end_line"),
                F.array_join(F.col("entries.line"), "\n"),
            ).alias("listing"),
        )
    )
