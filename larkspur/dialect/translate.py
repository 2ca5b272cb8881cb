"""The dialect, read by descent and restated as Spark SQL.

What differs from Spark SQL is settled here: quotients of integers truncate, an alias of an expression
may stand in WHERE, averages are doubles, strings take either quote, ``date('...')`` and ``interval 'n' unit``
are literals, the cast functions have names of their own, and LIKE may be read loosely. All the rest, the
scopes of subqueries included, is Spark's analysis of the restated text. Operators of one precedence
group from the left and NOT binds its own operand, as in standard SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from larkspur.functions.columns import SPECIAL, loose_regex

from .lexer import DialectError, Token, tokens

CLAUSES = {"from", "where", "group", "having", "order", "limit", "union", "on", "as", "and", "or", "not", "then", "when", "else", "end", "asc", "desc", "inner", "left", "right", "full", "cross", "join", "outer", "by", "in", "like", "between", "is", "offset", "nulls", "using"}
UNITS = ("second", "minute", "hour", "day", "week", "month", "year")
INTEGERS = {"int", "bigint", "smallint", "tinyint"}
#: Floating numbers round half to even, decimals lose the digits that do not fit, integers stay exact. Spark folds ``typeof``.
WHOLE = "CASE WHEN typeof({0}) IN ('float', 'double') THEN CAST(rint({0}) AS BIGINT) ELSE CAST({0} AS BIGINT) END"
CUT = "CAST(CASE WHEN typeof({{0}}) NOT LIKE 'decimal%' THEN CAST({{0}} AS {0}) WHEN {{0}} < 0 THEN ceil(CAST({{0}} AS DECIMAL(38,12)), {1}) ELSE floor(CAST({{0}} AS DECIMAL(38,12)), {1}) END AS {0})"
CASTS = {"cast_int": f"CAST({WHOLE} AS INT)", "cast_long": WHOLE, "cast_float": "CAST({0} AS FLOAT)", "cast_double": "CAST({0} AS DOUBLE)", "cast_decimal_15": CUT.format("DECIMAL(15,2)", 2), "cast_decimal_38": CUT.format("DECIMAL(38,6)", 6), "cast_datetime": "CAST({0} AS TIMESTAMP_NTZ)"}
FUNCTIONS = {"starts_with": "startswith(lower({0}), lower({1}))", "ends_with": "endswith(lower({0}), lower({1}))", "date": "to_date({0})"}


def literal(text: str) -> str:
    """Spark SQL of a string."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass
class Text:
    """Spark SQL of an expression, whether it is an integer, and the plain name if it is a column."""

    sql: str
    whole: bool = False
    name: str | None = None
    literal: str | None = None


@dataclass
class Translator:
    """``types`` maps each known column name to the set of its types; ``loose_like`` ignores case and does not anchor."""

    text: str
    types: dict[str, set[str]] = field(default_factory=dict)
    loose_like: bool = False

    def __post_init__(self) -> None:
        self.tokens = tokens(self.text)
        self.i = 0
        self.explain = False
        self.aliases: list[dict[str, Text]] = []

    # tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def peek(self, *words: str) -> bool:
        return all(self.tokens[min(self.i + k, len(self.tokens) - 1)].low == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            self.fail(f"expected {' '.join(words)}")

    def fail(self, why: str):
        line = self.text.count("\n", 0, self.now.at) + 1
        raise DialectError(f"{why}, found {self.now.text or 'the end'!r} in line {line}")

    def identifier(self) -> str:
        if self.now.kind != "word" or self.now.low in CLAUSES:
            self.fail("expected a name")
        self.i += 1
        return self.tokens[self.i - 1].text

    # statements

    def statement(self) -> str:
        self.explain = self.take("explain")
        out = self.query()
        self.take(";")
        if self.now.kind != "end":
            self.fail("expected the end")
        return out

    def query(self) -> str:
        parts = []
        if self.take("with"):
            tables = []
            while True:
                name, columns = self.identifier(), self.names() if self.peek("(") else ""
                self.need("as", "(")
                tables.append(f"{name}{columns} AS ({self.query()})")
                self.need(")")
                if not self.take(","):
                    break
            parts.append("WITH " + ", ".join(tables))
        return " ".join([*parts, self.select()])

    def names(self) -> str:
        self.need("(")
        out = [self.identifier()]
        while self.take(","):
            out.append(self.identifier())
        self.need(")")
        return f" ({', '.join(out)})"

    def select(self) -> str:
        self.need("select")
        distinct = self.take("distinct")
        if not distinct:
            self.take("all")
        self.aliases.append({})
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        out = [f"SELECT {'DISTINCT ' if distinct else ''}{', '.join(items)}"]
        self.need("from")
        out.append(f"FROM {self.sources()}")
        if self.take("where"):
            out.append(f"WHERE {self.expression().sql}")
        self.aliases.pop()
        self.aliases.append({})  # below WHERE, Spark resolves aliases itself
        if self.take("group", "by"):
            out.append("GROUP BY " + ", ".join(self.listed()))
        if self.take("having"):
            out.append(f"HAVING {self.expression().sql}")
        if self.take("order", "by"):
            keys = []
            while True:
                key = self.expression().sql
                key += " DESC" if self.take("desc") else " ASC" if self.take("asc") or True else ""
                if self.take("nulls"):
                    key += " NULLS FIRST" if self.take("first") else " NULLS LAST"
                    if not key.endswith("FIRST"):
                        self.need("last")
                else:
                    key += " NULLS LAST"
                keys.append(key)
                if not self.take(","):
                    break
            out.append("ORDER BY " + ", ".join(keys))
        if self.take("limit"):
            if self.now.kind != "number":
                self.fail("expected a number of rows")
            out.append(f"LIMIT {self.now.text}")
            self.i += 1
        self.aliases.pop()
        return " ".join(out)

    def listed(self) -> list[str]:
        out = [self.expression().sql]
        while self.take(","):
            out.append(self.expression().sql)
        return out

    def item(self) -> str:
        if self.take("*"):
            return "*"
        if self.now.kind == "word" and self.tokens[self.i + 1].text == "." and self.tokens[self.i + 2].text == "*":
            name = self.identifier()
            self.i += 2
            return f"{name}.*"
        value = self.expression()
        if not self.take("as"):
            return value.sql
        alias = self.identifier()
        if value.name is None:
            self.aliases[-1][alias.lower()] = value
        return f"{value.sql} AS {alias}"

    def sources(self) -> str:
        out = self.source()
        while True:
            if self.take(","):
                out += f", {self.source()}"
                continue
            kind = self.join_kind()
            if kind is None:
                return out
            out += f" {kind} JOIN {self.source()}"
            if kind != "CROSS":
                if self.peek("using"):
                    self.i += 1
                    out += f" USING{self.names()}"
                else:
                    self.need("on")
                    out += f" ON {self.expression().sql}"

    def join_kind(self) -> str | None:
        for word in ("left", "right", "full"):
            if self.take(word):
                self.take("outer")
                self.need("join")
                return f"{word.upper()} OUTER"
        if self.take("cross"):
            self.need("join")
            return "CROSS"
        if self.take("inner"):
            self.need("join")
            return "INNER"
        return "INNER" if self.take("join") else None

    def source(self) -> str:
        if self.take("("):
            out = f"({self.query()})"
            self.need(")")
        else:
            out = self.identifier()
        named = self.take("as")
        if named or (self.now.kind == "word" and self.now.low not in CLAUSES):
            out += f" AS {self.identifier()}"
            if self.peek("("):
                out += self.names()
        return out

    # expressions

    def expression(self) -> Text:
        left = self.conjunction()
        while self.take("or"):
            left = Text(f"({left.sql} OR {self.conjunction().sql})")
        return left

    def conjunction(self) -> Text:
        left = self.negation()
        while self.take("and"):
            left = Text(f"({left.sql} AND {self.negation().sql})")
        return left

    def negation(self) -> Text:
        if self.take("not"):
            return Text(f"(NOT {self.negation().sql})")
        return self.comparison()

    def comparison(self) -> Text:
        left = self.sum()
        while True:
            if self.now.text in ("=", "!=", "<>", "<", "<=", ">", ">="):
                sign = self.now.text
                self.i += 1
                left = Text(f"({left.sql} {sign} {self.sum().sql})")
            elif self.take("is"):
                no = " NOT" if self.take("not") else ""
                self.need("null")
                left = Text(f"({left.sql} IS{no} NULL)")
            elif self.peek("not") and self.tokens[self.i + 1].low in ("in", "like", "between") or self.now.low in ("in", "like", "between"):
                left = self.membership(left, self.take("not"))
            else:
                return left

    def membership(self, left: Text, negated: bool) -> Text:
        no = "NOT " if negated else ""
        if self.take("between"):
            low = self.sum().sql
            self.need("and")
            return Text(f"({left.sql} {no}BETWEEN {low} AND {self.sum().sql})")
        if self.take("like"):
            pattern = self.sum()
            if not self.loose_like:
                return Text(f"({left.sql} {no}LIKE {pattern.sql})")
            if pattern.literal is None:
                quoted = f"regexp_replace({pattern.sql}, {literal(SPECIAL)}, {literal(chr(92) * 2 + '$1')})"
                return Text(f"({no}{left.sql} RLIKE concat('(?is)', replace({quoted}, '%', '.*')))")
            return Text(f"({no}{left.sql} RLIKE {literal(loose_regex(pattern.literal))})")
        self.need("in", "(")
        inner = self.query() if self.now.low in ("select", "with") else ", ".join(self.listed())
        self.need(")")
        return Text(f"({left.sql} {no}IN ({inner}))")

    def sum(self) -> Text:
        left = self.term()
        while self.now.text in ("+", "-"):
            sign = self.now.text
            self.i += 1
            right = self.term()
            left = Text(f"({left.sql} {sign} {right.sql})", left.whole and right.whole)
        return left

    def term(self) -> Text:
        left = self.factor()
        while self.now.text in ("*", "/", "%"):
            sign = self.now.text
            self.i += 1
            right = self.factor()
            whole = left.whole and right.whole
            left = Text(f"({left.sql} {'DIV' if sign == '/' and whole else sign} {right.sql})", whole)
        return left

    def factor(self) -> Text:
        t = self.now
        if self.take("-"):
            inner = self.factor()
            return Text(f"(- {inner.sql})", inner.whole)
        if t.kind == "number":
            self.i += 1
            return Text(t.text, "." not in t.text)
        if t.kind == "string":
            self.i += 1
            quote = t.text[0]
            body = t.text[1:-1].replace(quote * 2, quote)
            return Text(literal(body), literal=body)
        if self.take("("):
            if self.now.low in ("select", "with"):
                inner = Text(f"({self.query()})")
            else:
                value = self.expression()
                inner = Text(f"({value.sql})", value.whole)
            self.need(")")
            return inner
        if t.kind != "word":
            self.fail("expected an expression")
        after = self.tokens[self.i + 1]
        if t.low == "date" and after.kind == "string":
            self.i += 2
            return Text(f"DATE {after.text}")
        if t.low == "timestamp" and after.kind == "string":
            self.i += 2
            return Text(f"TIMESTAMP_NTZ {after.text}")
        if t.low == "interval":
            return self.interval()
        if t.low == "case":
            return self.case()
        if t.low == "exists" and after.text == "(":
            self.i += 2
            inner = self.query()
            self.need(")")
            return Text(f"EXISTS ({inner})")
        if t.low in ("true", "false", "null"):
            self.i += 1
            return Text(t.low.upper())
        if after.text == "(":
            return self.call()
        return self.column()

    def interval(self) -> Text:
        self.i += 1
        if self.now.kind not in ("string", "number"):
            self.fail("expected a number in quotes")
        count = self.now.text.strip("'\"")
        self.i += 1
        unit = self.now.low[:-1] if self.now.low.endswith("s") else self.now.low
        if unit not in UNITS or not count.lstrip("-").isdigit():
            self.fail(f"expected one of {', '.join(UNITS)}")
        self.i += 1
        count, unit = (int(count) * 7, "day") if unit == "week" else (int(count), unit)
        return Text(f"INTERVAL '{count}' {unit.upper()}")

    def case(self) -> Text:
        self.i += 1
        out, whole = "CASE", True
        if not self.peek("when"):
            out += f" {self.expression().sql}"
        while self.take("when"):
            condition = self.expression().sql
            self.need("then")
            value = self.expression()
            whole &= value.whole
            out += f" WHEN {condition} THEN {value.sql}"
        if self.take("else"):
            value = self.expression()
            whole &= value.whole
            out += f" ELSE {value.sql}"
        self.need("end")
        return Text(f"{out} END", whole)

    def call(self) -> Text:
        name = self.identifier()
        low = name.lower()
        self.need("(")
        if low == "extract":
            part = self.identifier().lower()
            self.need("from")
            value = self.expression().sql
            self.need(")")
            if part not in UNITS or part == "week":
                self.fail(f"extract knows no {part}")
            return Text(f"CAST(extract({part} FROM {value}) AS INT)", True)
        if low == "cast":
            value = self.expression().sql
            self.need("as")
            kind = self.identifier()
            if self.take("("):
                digits = [self.now.text]
                self.i += 1
                while self.take(","):
                    digits.append(self.now.text)
                    self.i += 1
                self.need(")")
                kind += f"({','.join(digits)})"
            self.need(")")
            return Text(f"CAST({value} AS {kind})", kind.lower() in INTEGERS)
        if low == "substring" and not self.peek(")"):
            args = [self.expression().sql]
            if self.take("from"):
                args.append(self.expression().sql)
                if self.take("for"):
                    args.append(self.expression().sql)
            while self.take(","):
                args.append(self.expression().sql)
            self.need(")")
            return Text(f"substring({', '.join(args)})")
        distinct = "DISTINCT " if self.take("distinct") else ""
        if self.take("*"):
            self.need(")")
            return Text(f"{name}(*)", True)
        args = [] if self.peek(")") else [self.expression()]
        while self.take(","):
            args.append(self.expression())
        self.need(")")
        inner = [a.sql for a in args]
        if low == "avg":
            return Text(f"(CAST(sum({distinct}{inner[0]}) AS DOUBLE) / count({distinct}{inner[0]}))")
        for table in (CASTS, FUNCTIONS):
            if low in table:
                return Text(table[low].format(*inner), low in ("cast_int", "cast_long"))
        whole = low == "count" or low in ("sum", "min", "max") and all(a.whole for a in args)
        return Text(f"{name}({distinct}{', '.join(inner)})", whole)

    def column(self) -> Text:
        name = self.identifier()
        if self.take("."):
            column = self.identifier()
            return Text(f"{name}.{column}", self.integer(column), f"{name}.{column}")
        meant = self.aliases[-1].get(name.lower()) if self.aliases else None
        if meant is not None and name.lower() not in self.types:
            return meant
        return Text(name, self.integer(name), name)

    def integer(self, column: str) -> bool:
        kinds = self.types.get(column.lower(), set())
        return bool(kinds) and kinds <= INTEGERS


def translate(text: str, types: dict[str, set[str]] | None = None, loose_like: bool = False) -> tuple[str, bool]:
    """Spark SQL for a statement, and whether it asks for its plan."""
    t = Translator(text, types or {}, loose_like)
    return t.statement(), t.explain
