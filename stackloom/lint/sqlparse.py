"""A small SQL parser: enough structure for lint features, for statements of the common dialects.

Expressions are tuples whose first item names their kind; queries and selects
are dicts. What the parser does not know raises ``SqlError``.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""(?P<ws>\s+|--[^\n]*|\#(?![>\-])[^\n]*|/\*.*?\*/)
      |(?P<dollar>\$(?P<tag>[A-Za-z_]*)\$.*?\$(?P=tag)\$)
      |(?P<str>[eEnNbBxX]?'(?:[^']|'')*')
      |(?P<quoted>"(?:[^"]|"")*"|`[^`]*`|\[[A-Za-z_][^\]]*\])
      |(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)
      |(?P<word>[A-Za-z_\u0080-￿@:?$][\w$@:\u0080-￿]*(?<!:)|\?|\$\d+|%\(\w+\)s|%s)
      |(?P<op>->>|\#>>|->|\#>|::|<=>|<>|!=|<=|>=|\|\||:=|!~\*|!~|~\*|@>|<@|&&|[-+*/%<>=(),.;~&|^\[\]{}:!@])""",
    re.X | re.S,
)
_STOP = set(
    "FROM WHERE GROUP HAVING ORDER LIMIT OFFSET FETCH UNION EXCEPT INTERSECT ON USING JOIN INNER LEFT RIGHT FULL CROSS NATURAL SET VALUES RETURNING WINDOW FOR AS AND OR NOT IN IS LIKE ILIKE "
    "BETWEEN THEN ELSE WHEN END ASC DESC NULLS BY SELECT LATERAL QUALIFY STRAIGHT_JOIN SIMILAR RLIKE REGEXP COLLATE".split()
)
_BINARY = {"OR": 1, "AND": 2, "=": 4, "<>": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "<=>": 4, "~": 4, "~*": 4, "!~": 4, "!~*": 4, "@>": 4, "<@": 4, "&&": 4, "||": 5, "&": 5, "|": 5,
           "+": 6, "-": 6, "*": 7, "/": 7, "%": 7, "^": 8, "->": 9, "->>": 9, "#>": 9, "#>>": 9}


class SqlError(ValueError):
    """The text is no statement this parser knows."""


class Parser:
    def __init__(self, text: str) -> None:
        self.toks: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SqlError(f"unexpected character at {at}")
            kind = m.lastgroup if m.lastgroup != "tag" else "dollar"
            if kind != "ws":
                self.toks.append(("str" if kind == "dollar" else kind, m.group()))
            at = m.end()
        self.i = 0
        self.depth = 0

    # -- tokens
    def kind(self, ahead: int = 0) -> str:
        return self.toks[self.i + ahead][0] if self.i + ahead < len(self.toks) else ""

    def word(self, ahead: int = 0) -> str:
        """The upper-cased word or operator at a position; quoted names and strings give ''."""
        k = self.kind(ahead)
        return self.toks[self.i + ahead][1].upper() if k in ("word", "op") else ""

    def take(self, *words: str) -> bool:
        if all(self.word(n) == w for n, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise SqlError(f"expected {word}")

    def name(self) -> list[str]:
        parts = []
        while self.kind() in ("word", "quoted"):
            parts.append(self.toks[self.i][1].strip('"`[]'))
            self.i += 1
            if not (self.word() == "." and (self.kind(1) in ("word", "quoted") or self.word(1) == "*")):
                break
            self.i += 1
            if self.word() == "*":
                break
        if not parts:
            raise SqlError("expected a name")
        return parts

    def skip_parens(self) -> None:
        self.need("(")
        level = 1
        while level:
            w = self.word()
            if not self.kind():
                raise SqlError("unbalanced parenthesis")
            level += (w == "(") - (w == ")")
            self.i += 1

    def rest(self) -> None:
        self.i = len(self.toks)

    # -- statements
    def statement(self) -> dict:
        w = self.word()
        if w in ("SELECT", "WITH", "VALUES", "("):
            if w == "WITH":
                self.ctes()
                w = self.word()
            if w in ("SELECT", "VALUES", "("):
                out = {"kind": "query", "query": self.query()}
            else:
                return self.statement()
        elif self.take("INSERT") or self.take("REPLACE"):
            out = self.insert()
        elif self.take("UPDATE"):
            self.take("ONLY")
            self.table()
            self.need("SET")
            self.assignments()
            if self.take("FROM"):
                self.tables()
            out = {"kind": "update", "where": self.expr() if self.take("WHERE") else None}
            self.rest()
        elif self.take("DELETE"):
            self.need("FROM")
            self.tables()
            if self.take("USING"):
                self.tables()
            out = {"kind": "delete", "where": self.expr() if self.take("WHERE") else None}
            self.rest()
        elif self.take("CREATE"):
            out = {"kind": "create"}
            self.take("UNIQUE")
            if self.take("INDEX"):
                out = {"kind": "create_index", "concurrently": self.take("CONCURRENTLY")}
            self.rest()
        elif self.take("DROP"):
            out = {"kind": "drop_table" if self.take("TABLE") else "drop"}
            self.rest()
        elif self.take("ALTER"):
            out = self.alter() if self.take("TABLE") else {"kind": "alter"}
            self.rest()
        elif w in ("TRUNCATE", "GRANT", "REVOKE", "COMMENT", "SET", "BEGIN", "COMMIT", "ROLLBACK", "ANALYZE", "VACUUM", "EXPLAIN", "CALL", "DO", "START", "LOCK", "USE", "SHOW", "COPY", "MERGE", "REINDEX", "REFRESH"):
            out = {"kind": "other"}
            self.rest()
        else:
            raise SqlError("not a statement")
        self.take(";")
        if self.kind():
            raise SqlError("text after the statement")
        return out

    def ctes(self) -> None:
        self.need("WITH")
        self.take("RECURSIVE")
        while True:
            self.name()
            if self.word() == "(":
                self.skip_parens()
            self.need("AS")
            self.take("NOT")
            self.take("MATERIALIZED")
            self.skip_parens()
            if not self.take(","):
                return

    def assignments(self) -> None:
        while True:
            if self.word() == "(":
                self.skip_parens()
            else:
                self.name()
            if not (self.take("=") or self.take(":=")):
                raise SqlError("expected =")
            if not self.take("DEFAULT"):
                self.expr()
            if not self.take(","):
                return

    def insert(self) -> dict:
        for w in ("OR", "REPLACE", "IGNORE", "ABORT", "INTO", "OVERWRITE", "TABLE"):
            self.take(w)
        self.name()
        if self.take("AS"):
            self.name()
        columns = self.word() == "(" and self.word(1) not in ("SELECT", "WITH", "VALUES")
        if columns:
            self.skip_parens()
        if self.take("OVERRIDING"):
            self.i += 2
        values = self.word() == "VALUES"
        out = {"kind": "insert", "columns": columns, "values": values, "query": None}
        if not values and self.word() in ("SELECT", "WITH", "("):
            if self.word() == "WITH":
                self.ctes()
            out["query"] = self.query()
        self.rest()
        return out

    def alter(self) -> dict:
        self.take("IF", "EXISTS")
        self.take("ONLY")
        self.name()
        ops: list[str] = []
        while self.kind():
            first = self.i
            if self.take("DROP"):
                named = not self.take("COLUMN") and self.word() in ("CONSTRAINT", "INDEX", "PRIMARY", "FOREIGN", "PARTITION", "DEFAULT", "KEY", "CHECK")
                if not named:
                    ops.append("drop_column")
            elif self.take("ALTER") or self.take("MODIFY") or self.take("CHANGE"):
                changed = self.toks[self.i - 1][1].upper() != "ALTER"
                self.take("COLUMN")
                self.name()
                if changed or self.word() == "TYPE" or (self.word() == "SET" and self.word(1) == "DATA"):
                    ops.append("alter_type")
            elif self.take("ADD"):
                words = self.clause()
                if "FOREIGN" in words and words[:1] in (["CONSTRAINT"], ["FOREIGN"]):
                    if ("NOT", "VALID") not in list(zip(words, words[1:])):
                        ops.append("add_fk")
                elif words[:1] not in (["CONSTRAINT"], ["PRIMARY"], ["UNIQUE"], ["CHECK"], ["INDEX"], ["KEY"], ["EXCLUDE"], ["PARTITION"]):
                    if ("NOT", "NULL") in list(zip(words, words[1:])) and "DEFAULT" not in words:
                        ops.append("add_not_null")
            self.clause()
            self.take(",")
            if self.i == first:
                self.i += 1
        return {"kind": "alter_table", "ops": ops}

    def clause(self) -> list[str]:
        """The words up to the next comma outside parentheses."""
        words, level = [], 0
        while self.kind() and not (level == 0 and self.word() in (",", ";")):
            w = self.word()
            level += (w == "(") - (w == ")")
            if level == 0 and self.kind() == "word":
                words.append(w)
            self.i += 1
        return words

    # -- queries
    def query(self) -> dict:
        self.depth += 1
        if self.depth > 60:
            raise SqlError("nested too deeply")
        if self.word() == "WITH":
            self.ctes()
        body = self.set_expr()
        out = {"body": body, "order": [], "limit": None, "offset": None}
        if self.take("ORDER", "BY"):
            out["order"] = self.sort_items()
        while self.kind():
            if self.take("LIMIT"):
                first = None if self.take("ALL") else self.expr()
                if self.take(","):
                    out["offset"], first = first, self.expr()
                out["limit"] = first
            elif self.take("OFFSET"):
                out["offset"] = self.expr()
                self.take("ROWS") or self.take("ROW")
            elif self.take("FETCH"):
                self.i += 1
                if self.kind() == "num":
                    out["limit"] = ("lit", "num", self.toks[self.i][1])
                    self.i += 1
                self.i += 1
                self.take("ONLY") or self.take("WITH", "TIES")
            elif self.take("FOR"):
                while self.kind() and self.word() not in (")", ";"):
                    self.i += 1
            else:
                break
        self.depth -= 1
        return out

    def set_expr(self) -> tuple:
        left = self.set_term()
        while self.word() in ("UNION", "EXCEPT", "INTERSECT", "MINUS"):
            op = self.word()
            self.i += 1
            every = self.take("ALL")
            self.take("DISTINCT")
            left = ("set", op, every, left, self.set_term())
        return left

    def set_term(self) -> tuple:
        if self.take("("):
            q = self.query()
            self.need(")")
            return ("query", q)
        if self.take("VALUES"):
            while True:
                self.skip_parens()
                if not self.take(","):
                    return ("values",)
        return ("select", self.select())

    def select(self) -> dict:
        self.need("SELECT")
        distinct = self.take("DISTINCT") or self.take("UNIQUE")
        if distinct and self.take("ON"):
            self.skip_parens()
        self.take("ALL")
        if self.take("TOP"):
            self.expr(9)
        items: list[tuple] = []
        while self.word() not in ("FROM", "WHERE", ")", ";", "") or self.kind() not in ("", "op", "word"):
            items.append(self.item())
            if not self.take(","):
                break
        out = {"distinct": distinct, "items": items, "from": [], "where": None, "group": [], "having": None}
        if self.take("FROM"):
            out["from"] = self.tables()
        if self.take("WHERE"):
            out["where"] = self.expr()
        if self.take("GROUP", "BY"):
            while True:
                if self.word() in ("ROLLUP", "CUBE", "GROUPING"):
                    self.i += 1 + (self.word(1) == "SETS")
                    self.skip_parens()
                    out["group"].append(("other",))
                else:
                    out["group"].append(self.expr())
                if not self.take(","):
                    break
        if self.take("HAVING"):
            out["having"] = self.expr()
        if self.take("WINDOW"):
            while True:
                self.name()
                self.need("AS")
                self.skip_parens()
                if not self.take(","):
                    break
        return out

    def item(self) -> tuple:
        if self.take("*"):
            return ("star",)
        e = self.expr()
        if self.take("AS"):
            self.i += 1
        elif self.kind() in ("word", "quoted") and self.word() not in _STOP:
            self.i += 1
        return e

    def tables(self) -> list[tuple]:
        out = []
        while True:
            relation = self.table()
            joins = []
            while True:
                first = self.i
                self.take("NATURAL")
                for w in ("INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER", "SEMI", "ANTI", "ASOF", "GLOBAL"):
                    self.take(w)
                if not (self.take("JOIN") or self.take("STRAIGHT_JOIN") or self.take("APPLY")):
                    self.i = first
                    break
                target, on = self.table(), None
                if self.take("ON"):
                    on = self.expr()
                elif self.take("USING"):
                    self.skip_parens()
                joins.append((target, on))
            out.append((relation, joins))
            if not self.take(","):
                return out

    def table(self) -> tuple:
        self.take("LATERAL")
        self.take("ONLY")
        if self.take("("):
            if self.word() in ("SELECT", "WITH", "VALUES", "("):
                out: tuple = ("derived", self.query())
            else:
                self.tables()
                out = ("group",)
            self.need(")")
        else:
            if self.word() in _STOP - {"VALUES", "SET", "FOR"}:
                raise SqlError("expected a table")
            self.name()
            out = ("table",)
            if self.word() == "(":
                self.skip_parens()
        if self.take("AS"):
            self.name()
        elif self.kind() in ("word", "quoted") and self.word() not in _STOP:
            self.name()
        if self.word() == "(" and out[0] != "table":
            self.skip_parens()
        return out

    def sort_items(self) -> list[tuple]:
        out = []
        while True:
            out.append(self.expr())
            self.take("ASC") or self.take("DESC")
            if self.take("NULLS"):
                self.i += 1
            if not self.take(","):
                return out

    # -- expressions
    def expr(self, least: int = 0) -> tuple:
        self.depth += 1
        if self.depth > 300:
            raise SqlError("nested too deeply")
        left = self.prefix()
        while True:
            w = self.word()
            if w == "::":
                self.i += 1
                self.type_name()
                left = ("cast", left)
                continue
            if w == "[":
                while self.word() != "]" and self.kind():
                    self.i += 1
                self.need("]")
                continue
            if w == "COLLATE":
                self.i += 1
                self.name()
                continue
            if w == "AT" and self.word(1) == "TIME":
                self.i += 3
                self.expr(8)
                continue
            if w in ("IS", "NOT", "LIKE", "ILIKE", "IN", "BETWEEN", "SIMILAR", "RLIKE", "REGEXP", "ISNULL", "NOTNULL"):
                if least > 4:
                    break
                left = self.predicate(left)
                if left is None:
                    raise SqlError("incomplete predicate")
                continue
            level = _BINARY.get(w)
            if level is None or level < least:
                break
            self.i += 1
            if self.word() in ("ANY", "ALL", "SOME") and self.word(1) == "(":
                self.i += 1
            left = ("bin", w, left, self.expr(level + 1))
        self.depth -= 1
        return left

    def predicate(self, left: tuple) -> tuple:
        if self.take("IS"):
            negated = self.take("NOT")
            if self.take("DISTINCT", "FROM"):
                return ("bin", "IS DISTINCT", left, self.expr(5))
            self.i += 1
            return ("isnull", negated, left)
        if self.take("ISNULL") or self.take("NOTNULL"):
            return ("isnull", False, left)
        negated = self.take("NOT")
        if self.take("LIKE") or self.take("ILIKE"):
            pattern = self.expr(5)
            if self.take("ESCAPE"):
                self.i += 1
            return ("like", negated, left, pattern)
        if self.take("SIMILAR", "TO") or self.take("RLIKE") or self.take("REGEXP"):
            return ("bin", "REGEXP", left, self.expr(5))
        if self.take("BETWEEN"):
            low = self.expr(5)
            self.need("AND")
            return ("between", negated, left, low, self.expr(5))
        if self.take("IN"):
            self.need("(") if self.word() == "(" else None
            if self.toks[self.i - 1][1] != "(":
                return ("inlist", negated, left, [self.expr(9)])
            if self.word() in ("SELECT", "WITH"):
                out = ("insub", negated, left, self.query())
            else:
                values = []
                while self.word() != ")":
                    values.append(self.expr())
                    if not self.take(","):
                        break
                out = ("inlist", negated, left, values)
            self.need(")")
            return out
        raise SqlError("unknown predicate")

    def type_name(self) -> None:
        self.name()
        while self.word() in ("VARYING", "PRECISION", "WITH", "WITHOUT", "TIME", "ZONE", "UNSIGNED"):
            self.i += 1
        if self.word() == "(":
            self.skip_parens()
        while self.word() == "[":
            while self.word() != "]" and self.kind():
                self.i += 1
            self.need("]")

    def prefix(self) -> tuple:
        k, w = self.kind(), self.word()
        if k in ("str", "num"):
            self.i += 1
            return ("lit", k, self.toks[self.i - 1][1])
        if w in ("NOT", "-", "+", "~", "!"):
            self.i += 1
            return ("un", w, self.expr(3 if w == "NOT" else 8))
        if w == "(":
            self.i += 1
            if self.word() in ("SELECT", "WITH"):
                out: tuple = ("sub", self.query())
            else:
                out = ("nest", self.expr())
                if self.word() == ",":
                    while self.take(","):
                        self.expr()
                    out = ("tuple",)
            self.need(")")
            return out
        if w == "EXISTS":
            self.i += 1
            self.need("(")
            q = self.query()
            self.need(")")
            return ("exists", q)
        if w == "CASE":
            return self.case()
        if w in ("NULL", "TRUE", "FALSE"):
            self.i += 1
            return ("lit", w.lower(), w)
        if w in ("CAST", "TRY_CAST") and self.word(1) == "(":
            self.i += 2
            e = self.expr()
            self.need("AS")
            self.type_name()
            self.need(")")
            return ("cast", e)
        if w == "INTERVAL" and self.kind(1) in ("str", "num"):
            self.i += 2
            if self.kind() == "word" and self.word() not in _STOP:
                self.i += 1
            return ("lit", "interval", "")
        if w in ("DATE", "TIMESTAMP", "TIME") and self.kind(1) == "str":
            self.i += 2
            return ("lit", "time", "")
        if w == "ARRAY" and self.word(1) == "[":
            while self.word() != "]" and self.kind():
                self.i += 1
            self.need("]")
            return ("other",)
        if w == "*":
            self.i += 1
            return ("star",)
        if k in ("word", "quoted") and w not in _STOP:
            parts = self.name()
            if self.word() == "*" and self.toks[self.i - 1][1] == ".":
                self.i += 1
                return ("qualified_star",)
            if self.word() == "(":
                return self.call(parts)
            return ("col", parts)
        if w in ("LEFT", "RIGHT", "REPLACE", "VALUES", "SET") and self.word(1) == "(":
            self.i += 1
            return self.call([w])
        raise SqlError(f"unexpected {w or 'end'}")

    def case(self) -> tuple:
        self.need("CASE")
        if self.word() != "WHEN":
            self.expr()
        while self.take("WHEN"):
            self.expr()
            self.need("THEN")
            self.expr()
        if self.take("ELSE"):
            self.expr()
        self.need("END")
        return ("case",)

    def call(self, parts: list[str]) -> tuple:
        self.need("(")
        self.take("DISTINCT") or self.take("ALL")
        args: list[tuple] = []
        while self.word() != ")":
            if self.word() in ("SELECT", "WITH"):
                args.append(("sub", self.query()))
            else:
                args.append(self.expr())
            if self.take("AS"):
                self.type_name()
            if self.take("FROM") or self.take("FOR") or self.take("IN"):
                continue
            if self.take("ORDER", "BY"):
                self.sort_items()
            if not self.take(","):
                break
        self.need(")")
        if self.take("WITHIN", "GROUP"):
            self.skip_parens()
        if self.take("FILTER"):
            self.skip_parens()
        over = None
        if self.take("OVER"):
            over = self.window() if self.word() == "(" else (self.name(), ())[1] or {"partition": True, "order": False}
        return ("fn", parts[-1].upper(), args, over)

    def window(self) -> dict:
        self.need("(")
        out = {"partition": False, "order": False}
        if self.take("PARTITION", "BY"):
            out["partition"] = True
            self.expr()
            while self.take(","):
                self.expr()
        if self.take("ORDER", "BY"):
            out["order"] = True
            self.sort_items()
        level = 1
        while level:
            w = self.word()
            if not self.kind():
                raise SqlError("unbalanced parenthesis")
            level += (w == "(") - (w == ")")
            self.i += 1
        return out


def parse(text: str) -> dict:
    return Parser(text).statement()


def split_statements(text: str) -> list[tuple[int, str]]:
    """(line of the first token, statement) of a script.

    Cuts at ``;`` outside of quotes, comments and dollar-quoted bodies. Blank
    and comment-only pieces are dropped.
    """
    out, start, at = [], 0, 0
    cut = re.compile(r"'[^']*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\$((?:[A-Za-z_]\w*)?)\$.*?\$\1\$|;|.", re.S)
    for m in cut.finditer(text):
        if m.group() == ";":
            out.append((start, text[start : m.start()]))
            start = m.end()
        at = m.end()
    out.append((start, text[start:at]))
    done = []
    for offset, piece in out:
        lead = re.match(r"(?:\s+|--[^\n]*(?:\n|$)|/\*.*?\*/)*", piece, re.S).end()
        if piece[lead:].strip():
            done.append((text.count("\n", 0, offset + lead) + 1, piece[lead:].strip()))
    return done
