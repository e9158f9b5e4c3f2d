"""Rules over call chains (52 of ten data layers, 7 of two parallel tracks), predicted statements and their 14 rules.

A chain is one row with its root, its steps and what is known about it; a rule is
a predicate over that row. Facts that need a second row (what a variable is bound
to, which attributes a loop reads) are columns that the extractor has filled in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stackloom.functions.scalar import severity_rank
from stackloom.session import materialize

# -- vocabulary of the predicates, as SQL over a chain row


def _has(*names: str) -> str:
    return f"arrays_overlap(methods, array({', '.join(repr(n) for n in names)}))"


def _last(*names: str) -> str:
    return f"last_method IN ({', '.join(repr(n) for n in names)})"


def _arg(methods: tuple[str, ...], test: str) -> str:
    """Some argument ``a`` of one of the steps meets a test; no methods means any step."""
    steps = f"filter(steps, s -> s.method IN ({', '.join(repr(m) for m in methods)}))" if methods else "steps"
    return f"exists(flatten(transform({steps}, s -> s.args)), a -> {test})"


# Names of clients, verbs and receivers by which the rules know a data layer.
_TEMPLATE = "contains(a, '${')"
_PY_FORMAT = "startswith(a, 'f\"') OR startswith(a, \"f'\") OR contains(a, ' % ')"
_REPO = "(base RLIKE '(Repo|Repository)$' OR base = 'repo')"
_PASCAL = "root RLIKE '^[A-Z]'"
_MODEL = f"({_PASCAL} AND {_has('findAll', 'findOne', 'findByPk', 'findOrCreate', 'create', 'bulkCreate', 'update', 'destroy', 'count')})"
_GORM_DB = "(root IN ('db', 'DB', 'tx') OR root RLIKE 'DB$' OR first_method IN ('db', 'DB', 'tx') OR first_method RLIKE 'DB$')"
_SQLX = "(root = 'sqlx' OR first_method = 'sqlx' OR root = '')"
_MANAGER = "root IN ('em', 'entityManager')"
_JPA_REPO = f"(root RLIKE '(Repo|Repository)$' OR {_MANAGER} OR (root = 'this' AND first_method RLIKE '(Repo|Repository)$'))"
_LLM_CALL = f"({_has('create', 'stream')} AND {_has('chat', 'completions', 'messages', 'responses')})"
_LLM_CLIENTS = "('OpenAI', 'AsyncOpenAI', 'Anthropic', 'AsyncAnthropic', 'Cohere', 'Mistral', 'Together')"
_QUERYSET = "(root_binding = 'queryset' OR (root RLIKE '^[A-Z]' AND array_contains(methods, 'objects')))"


@dataclass(frozen=True)
class ChainRule:
    id: str
    track: str
    severity: str
    effort: str
    confidence: float
    when: str
    record: str = "chain"


def _r(id_: str, track: str, grade: str, confidence: float, when: str, record: str = "chain") -> ChainRule:
    severity, effort = grade.split("/")
    return ChainRule(id_, track, severity, effort, confidence, when, record)


# Ids, severities, efforts and confidences, with the shapes on which the rules fire.
RULES = [
    _r("DJ-N1-001", "django", "high/small", 0.85, "uncovered IS NOT NULL"),
    _r("DJ-N1-002", "django", "low/small", 0.70, f"{_last('count')} AND root_binding = 'queryset' AND root_reused"),
    _r("DJ-N1-003", "django", "medium/trivial", 0.95, "root = '' AND first_method = 'len' AND arg_binding = 'queryset'"),
    _r("DJ-N1-004", "django", "low/trivial", 0.95, f"{_last('count')} AND {_QUERYSET} AND NOT {_has('exists')}"),
    _r("DJ-N1-005", "django", "medium/trivial", 0.80, "root = '' AND first_method = 'bool' AND arg_binding = 'queryset'"),
    _r("DJ-PERF-006", "django", "high/small", 0.85, f"in_loop AND {_last('save')} AND root_binding IN ('instance', 'instance_of_queryset')"),
    _r("DJ-PERF-007", "django", "high/small", 0.90, f"in_loop AND {_last('create')} AND {_has('objects')}"),
    _r("DJ-PERF-008", "django", "low/medium", 0.65, f"in_loop AND {_last('save')} AND root_binding = 'instance_of_queryset'"),
    _r("DJ-EAGER-009", "django", "medium/trivial", 0.85, f"{_has('iterator')} AND {_has('prefetch_related')}"),
    _r("DJ-PROJ-010", "django", "medium/medium", 0.90, _arg(("values", "values_list"), "array_contains(collection_fields, trim(BOTH '\"' FROM replace(a, \"'\", '\"')))")),
    _r("DJ-RAW-011", "django", "high/small", 0.95, _arg(("raw", "extra"), _PY_FORMAT)),
    _r("DJ-PAG-012", "django", "low/medium", 0.40, f"first_method = 'Paginator' AND {_has('page')}"),
    _r("SA-N1-001", "sqlalchemy", "high/small", 0.80, f"in_loop AND size(steps) >= 2 AND root RLIKE '^[a-z]' AND root NOT IN ('self', 'session', 'db') AND NOT {_has('joinedload', 'selectinload', 'subqueryload', 'options', 'add', 'commit', 'execute', 'delete', 'flush')} AND (size(relation_fields) = 0 OR arrays_overlap(methods, relation_fields))"),
    _r("SA-N1-002", "sqlalchemy", "medium/small", 0.92, _arg(("joinedload",), "array_contains(collection_fields, substring_index(a, '.', -1))")),
    _r("SA-N1-003", "sqlalchemy", "high/trivial", 0.95, f"{_has('yield_per')} AND ({_has('joinedload', 'subqueryload')} OR {_arg(('options',), 'a RLIKE ' + repr('(joinedload|subqueryload)'))})"),
    _r("SA-PERF-004", "sqlalchemy", "medium/trivial", 0.85, "root = '' AND first_method = 'len' AND arg_binding = 'fetched'"),
    _r("SA-PERF-005", "sqlalchemy", "high/small", 0.85, f"in_loop AND {_has('select')}"),
    _r("SA-DTO-006", "sqlalchemy", "low/small", 0.55, f"bound_to IS NOT NULL AND loop_reads BETWEEN 1 AND 2 AND ({_has('select')} OR {_arg((), 'contains(a, ' + repr('select(') + ')')})"),
    _r("SA-SESS-007", "sqlalchemy", "medium/small", 0.65, f"in_loop AND {_last('add')}"),
    _r("SA-LAZY-008", "sqlalchemy", "medium/medium", 0.85, _arg(("relationship",), "replace(a, ' ', '') IN ('lazy=\"dynamic\"', \"lazy='dynamic'\")")),
    _r("SA-EXEC-009", "sqlalchemy", "high/small", 0.95, _arg(("text",), _PY_FORMAT)),
    _r("SA-AUTO-010", "sqlalchemy", "low/small", 0.55, f"in_loop AND {_last('add')} AND loop_selects"),
    _r("PRI-INC-001", "prisma", "medium/medium", 0.70, f"{_last('findMany', 'findUnique', 'findFirst')} AND {_arg((), 'a RLIKE ' + repr('(?s)include *: *[{].*include *: *[{].*include *: *[{]'))}"),
    _r("PRI-N1-002", "prisma", "high/small", 0.90, f"in_loop AND {_last('findUnique', 'findFirst')}"),
    _r("PRI-RAW-003", "prisma", "high/small", 0.95, _arg(("$queryRawUnsafe", "$executeRawUnsafe"), f"{_TEMPLATE} OR contains(a, ' + ')")),
    _r("PRI-PAG-004", "prisma", "medium/medium", 0.95, f"{_last('findMany', 'findFirst')} AND {_arg((), 'coalesce(try_cast(regexp_extract(a, ' + repr('skip *: *([0-9]+)') + ', 1) as bigint), 0) >= 1000')}"),
    _r("DRZ-LMT-001", "drizzle", "medium/trivial", 0.90, f"{_has('limit')} AND NOT {_has('orderBy')}"),
    _r("DRZ-N1-002", "drizzle", "high/small", 0.85, f"in_loop AND {_has('select')} AND {_has('where')}"),
    _r("DRZ-CTR-003", "drizzle", "low/trivial", 0.55, f"{_has('select')} AND {_has('from')} AND length_read"),
    _r("TO-N1-001", "typeorm", "high/small", 0.90, f"in_loop AND {_REPO} AND {_last('findOne', 'findOneBy', 'findOneByOrFail')}"),
    _r("TO-EAGER-002", "typeorm", "medium/medium", 0.85, "name RLIKE '^@(OneToMany|ManyToMany)' AND contains(name, 'eager:') AND contains(name, 'true')", "decorator"),
    _r("TO-QB-003", "typeorm", "high/small", 0.95, f"{_has('createQueryBuilder')} AND {_arg(('where', 'andWhere', 'orWhere'), _TEMPLATE)}"),
    _r("TO-SYNC-004", "typeorm", "high/small", 0.95, f"{_has('DataSource')} AND {_arg((), 'contains(a, ' + repr('synchronize') + ') AND contains(a, ' + repr('true') + ')')}"),
    _r("SEQ-N1-001", "sequelize", "high/small", 0.90, f"in_loop AND {_MODEL} AND {_last('findByPk', 'findOne')}"),
    _r("SEQ-RAW-002", "sequelize", "high/small", 0.95, f"root IN ('sequelize', 'db') AND {_arg(('query',), _TEMPLATE)}"),
    _r("SEQ-SAVE-003", "sequelize", "high/small", 0.85, f"in_loop AND {_last('save', 'update', 'destroy')} AND NOT {_MODEL}"),
    _r("SEQ-SYNC-004", "sequelize", "high/trivial", 0.95, f"root IN ('sequelize', 'db') AND {_arg(('sync',), 'contains(a, ' + repr('force') + ') AND contains(a, ' + repr('true') + ')')}"),
    _r("MNG-POP-001", "mongoose", "medium/medium", 0.80, "size(filter(methods, m -> m = 'populate')) >= 3"),
    _r("MNG-N1-002", "mongoose", "high/small", 0.90, f"in_loop AND {_PASCAL} AND {_last('findById', 'findOne')}"),
    _r("MNG-LEAN-003", "mongoose", "low/trivial", 0.70, f"in_loop AND {_has('toObject', 'toJSON')} AND NOT {_has('lean')}"),
    _r("MNG-RAW-004", "mongoose", "high/small", 0.95, _arg(("find", "findOne"), f"contains(a, '$where') AND {_TEMPLATE}")),
    _r("JPA-N1-001", "jpa", "high/small", 0.90, f"in_loop AND (({_JPA_REPO} AND (last_method IN ('findById', 'getOne', 'getReferenceById') OR startswith(last_method, 'findBy'))) OR ({_MANAGER} AND last_method = 'find'))"),
    _r("JPA-QRY-002", "jpa", "high/small", 0.95, "startswith(name, '@Query') AND name RLIKE '\" *[+]|[+] *\"'", "decorator"),
    _r("JPA-EAGER-003", "jpa", "medium/medium", 0.85, "name RLIKE '^@(OneToMany|ManyToMany|OneToOne|ManyToOne)' AND contains(name, 'EAGER')", "decorator"),
    _r("JPA-SAVE-004", "jpa", "high/small", 0.90, f"in_loop AND {_JPA_REPO} AND {_last('save', 'persist', 'merge')}"),
    _r("GORM-N1-001", "gorm", "high/small", 0.90, f"in_loop AND {_GORM_DB} AND {_last('First', 'Take', 'Last', 'FirstOrInit', 'FirstOrCreate')}"),
    _r("GORM-RAW-002", "gorm", "high/small", 0.95, _arg(("Raw", "Exec"), "contains(a, 'Sprint') OR a RLIKE '\" *[+]|[+] *\"'")),
    _r("GORM-AUTO-003", "gorm", "high/medium", 0.95, f"{_GORM_DB} AND {_last('AutoMigrate')}"),
    _r("GORM-SAVE-004", "gorm", "high/small", 0.90, f"in_loop AND {_GORM_DB} AND {_last('Create', 'Save', 'Update', 'Updates')}"),
    _r("SQLX-RAW-001", "sqlx", "high/small", 0.95, f"{_SQLX} AND {_arg(('query', 'execute'), 'contains(a, ' + repr('format!') + ') OR contains(a, ' + repr('.to_string()') + ')')}"),
    _r("SQLX-N1-002", "sqlx", "high/small", 0.85, f"in_loop AND {_SQLX} AND first_method IN ('query', 'query_as', 'query_scalar', 'query_unchecked', 'query_file')"),
    _r("SQLX-FETCH-003", "sqlx", "medium/small", 0.75, f"{_SQLX} AND {_has('fetch_all', 'fetch')} AND NOT {_arg((), 'contains(a, ' + repr('LIMIT') + ')')}"),
    _r("LLM-CLI-001", "llm", "high/small", 0.90, f"in_loop AND (root IN {_LLM_CLIENTS} OR first_method IN {_LLM_CLIENTS} OR last_method IN {_LLM_CLIENTS})"),
    _r("LLM-LOOP-002", "llm", "high/medium", 0.85, f"in_loop AND {_LLM_CALL}"),
    _r("LLM-SYNC-003", "llm", "high/trivial", 0.80, f"is_async AND root_binding = 'sync_client' AND {_LLM_CALL}"),
    _r("LLM-CACHE-004", "llm", "medium/small", 0.75, f"{_has('messages')} AND {_last('create')} AND {_arg((), 'startswith(a, ' + repr('system=') + ')')} AND NOT {_arg((), 'contains(a, ' + repr('cache_control') + ')')}"),
    _r("AC-BCRYPT-001", "auth_crypto", "high/medium", 0.90, f"in_loop AND ((root = 'bcrypt' AND {_last('hashpw', 'checkpw', 'kdf')}) OR ({_last('hash')} AND lower(root) RLIKE '(pwd|pass|crypt)'))"),
    _r("AC-RSA-002", "auth_crypto", "high/medium", 0.85, f"{_last('generate_private_key', 'generate')} AND (in_loop OR exists(imports, i -> contains(lower(i), 'rsa')))"),
    _r("AC-JWKS-003", "auth_crypto", "high/small", 0.85, f"{_last('get', 'urlopen', 'fetch_jwks')} AND {_arg((), 'contains(lower(a), ' + repr('jwks') + ') OR contains(a, ' + repr('.well-known') + ')')}"),
]
# A track's languages, and what shows that a file uses it: prefixes of its imports, or methods of its chains.
GATES = {
    "django": (["python"], ["django"], "exists(file_methods, m -> m = 'objects')"),
    "sqlalchemy": (["python"], ["sqlalchemy"], "arrays_overlap(file_methods, array('joinedload', 'selectinload', 'declarative_base', 'sessionmaker', 'relationship', 'scalars'))"),
    "prisma": (["typescript", "javascript"], ["@prisma", "prisma"], "array_contains(file_methods, 'PrismaClient') OR exists(file_methods, m -> m IN ('findUnique', 'findMany', '$queryRaw'))"),
    "drizzle": (["typescript", "javascript"], ["drizzle"], "array_contains(file_methods, 'drizzle')"),
    "typeorm": (["typescript", "javascript"], ["typeorm"], "array_contains(file_methods, 'createQueryBuilder')"),
    "sequelize": (["typescript", "javascript"], ["sequelize"], "arrays_overlap(file_methods, array('findByPk', 'bulkCreate'))"),
    "mongoose": (["typescript", "javascript"], ["mongoose"], "arrays_overlap(file_methods, array('populate', 'lean', 'findById'))"),
    "jpa": (["java", "kotlin", "scala"], ["javax.persistence", "jakarta.persistence", "org.springframework.data", "org.hibernate"], "false"),
    "gorm": (["go"], ["gorm.io", "github.com/jinzhu/gorm"], "array_contains(file_methods, 'AutoMigrate')"),
    "sqlx": (["rust"], ["sqlx"], "arrays_overlap(file_methods, array('query_as', 'query_scalar', 'fetch_all'))"),
    "llm": (["python"], [], "true"),
    "auth_crypto": (["python"], [], "true"),
}


def may_concern(content: Column) -> Column:
    """Cheap test of a file's text before it is parsed: some word of some track occurs."""
    words = ["objects", "select", "query", "find", "save", "execute", "prisma", "drizzle", "sequelize", "mongoose", "typeorm", "gorm", "sqlx", "EntityManager", "Repository", "openai", "anthropic", "bcrypt", "rsa", "jwks"]
    return content.rlike("(?i)" + "|".join(words))


def model_fields(records: DataFrame) -> DataFrame:
    """model fields that are relations: file, field, is_collection; from assignments of relation constructors and relation annotations."""
    made = records.filter("record_kind = 'chain' AND bound_to IS NOT NULL").select("file", F.col("bound_to").alias("field"), F.element_at("steps.method", -1).alias("m"), "steps")
    many = F.col("m").isin("ManyToManyField", "GenericRelation") | (F.col("m").isin("relationship") & ~F.exists(F.flatten("steps.args"), lambda a: F.contains(a, F.lit("uselist=False"))))
    return made.filter(F.col("m").isin("ForeignKey", "OneToOneField", "ManyToManyField", "GenericRelation", "relationship")).select("file", "field", many.alias("is_collection"))


def chain_rows(records: DataFrame) -> DataFrame:
    """Chains and decorators with the columns that the predicates use; facts of a file are joined by file."""
    imports = records.filter("record_kind = 'import'").groupBy("file").agg(F.sort_array(F.collect_set("module_path")).alias("imports"))
    chains = records.filter("record_kind IN ('chain', 'decorator')").withColumn("methods", F.coalesce(F.col("steps.method"), F.array().cast("array<string>")))
    facts = chains.groupBy("file").agg(F.array_distinct(F.flatten(F.collect_set("methods"))).alias("file_methods"))
    uses = records.filter("record_kind IN ('chain', 'loop') AND root <> ''").groupBy("file", "root").agg(F.count("*").alias("root_uses"))
    selects = chains.filter("in_loop AND (array_contains(methods, 'execute') OR array_contains(methods, 'scalars')) AND exists(flatten(steps.args), a -> contains(a, 'select('))").select("file", "loop_id").distinct().withColumn("loop_selects", F.lit(True))
    lengths = chains.filter("array_contains(methods, 'length')").select("file", F.col("root").alias("bound_to")).distinct().withColumn("length_read", F.lit(True))
    fields = model_fields(records).groupBy("file").agg(F.collect_set("field").alias("relation_fields"), F.collect_set(F.when(F.col("is_collection"), F.col("field"))).alias("collection_fields"))
    rows = chains.join(imports, "file", "left").join(facts, "file", "left").join(uses, ["file", "root"], "left").join(selects, ["file", "loop_id"], "left").join(lengths, ["file", "bound_to"], "left").join(fields, "file", "left")
    none = F.array().cast("array<string>")
    return rows.withColumns({
        "imports": F.coalesce("imports", none), "file_methods": F.coalesce("file_methods", none), "relation_fields": F.coalesce("relation_fields", none), "collection_fields": F.coalesce("collection_fields", none),
        "first_method": F.get("methods", F.lit(0)), "last_method": F.try_element_at("methods", F.lit(-1)), "root_reused": F.coalesce(F.col("root_uses") > 1, F.lit(False)),
        "loop_selects": F.coalesce("loop_selects", F.lit(False)), "length_read": F.coalesce("length_read", F.lit(False)), "in_loop": F.coalesce("in_loop", F.lit(False)),
        "steps": F.coalesce("steps", F.expr("cast(array() as array<struct<method: string, args: array<string>, line: int>>)")),
        "base": F.when(F.col("root").isin("this", "self", ""), F.coalesce(F.get("methods", F.lit(0)), F.lit(""))).otherwise(F.col("root")),
    }).withColumn("tracks", F.array_compact(F.array(*[F.when(F.expr(gate(t)), t) for t in GATES])))


def gate(track: str) -> str:
    languages, prefixes, shape = GATES[track]
    imported = " OR ".join(f"exists(imports, i -> startswith(i, {p!r}))" for p in prefixes) or "false"
    return f"language IN ({', '.join(repr(x) for x in languages)}) AND ({imported} OR {shape})"


def apply_chain_rules(rows: DataFrame, rules: list[ChainRule] | None = None) -> DataFrame:
    """file, line, byte_start, byte_end, rule_id, kind, severity, effort, confidence of every rule that fires on a chain or decorator."""
    rules = RULES if rules is None else rules
    cases = [
        F.when(
            F.expr(f"array_contains(tracks, {r.track!r}) AND record_kind = {r.record!r} AND coalesce({r.when}, false)"),
            F.struct(F.lit(r.id).alias("rule_id"), F.lit(f"{r.track}_antipattern").alias("kind"), F.lit(r.severity).alias("severity"), F.lit(r.effort).alias("effort"), F.lit(r.confidence).alias("confidence")),
        )
        for r in rules
    ]
    return rows.withColumn("__r", F.explode(F.array_compact(F.array(*cases)))).select("file", "line", F.coalesce("byte_start", "byte_offset").alias("byte_start"), F.coalesce("byte_end", "byte_offset").alias("byte_end"), "__r.*")


# -- predicted statements

#: Fields of a predicted statement.
PREDICTED = (
    "file string, line int, byte_start bigint, byte_end bigint, orm string, op string, n_tables int, projection string, per_outer_row boolean, has_where boolean, where_or boolean, where_function boolean, "
    "where_depth int, like_leading boolean, n_joins int, cartesian boolean, join_without_on boolean, row_limit bigint, row_offset bigint, ordered boolean, in_loop boolean, fidelity string"
)


def predict(rows: DataFrame) -> DataFrame:
    """Statements that chains of eight data layers stand for, as far as their shape tells."""
    null = F.lit(None)
    number = lambda methods: F.expr(f"try_cast(get(flatten(transform(filter(steps, s -> s.method IN ({', '.join(repr(m) for m in methods)})), s -> s.args)), 0) as bigint)")
    keyed = lambda key: F.expr(f"try_cast(regexp_extract(array_join(flatten(steps.args), ' '), '{key} *: *([0-9]+)', 1) as bigint)")
    has = lambda *m: F.expr(_has(*m))
    args = lambda *m: F.expr(f"flatten(transform(filter(steps, s -> s.method IN ({', '.join(repr(x) for x in m)})), s -> s.args))")
    false = F.lit(False)

    def make(orm: str, when: str, **facts: Column) -> DataFrame:
        base = {
            "op": F.lit("select"), "n_tables": F.lit(1), "projection": F.lit("unspecified"), "per_outer_row": false, "has_where": false, "where_or": false, "where_function": false, "where_depth": F.lit(0), "like_leading": false,
            "n_joins": F.lit(0), "cartesian": false, "join_without_on": false, "row_limit": null.cast("bigint"), "row_offset": null.cast("bigint"), "ordered": false, "fidelity": F.lit("skeletal"),
        }
        part = rows.filter(F.expr(f"array_contains(tracks, {orm!r}) AND record_kind = 'chain' AND coalesce({when}, false)"))
        made = {**base, **facts}
        return part.select("file", "line", "byte_start", "byte_end", F.lit(orm).alias("orm"), *[v.alias(k) for k, v in made.items()], "in_loop")

    literal = r"=\s*(\d+|\"[^\"]*\"|'[^']*'|True|False|None)\s*$"
    wanted = args("filter", "exclude", "get")
    known = {"objects", "filter", "exclude", "get", "all", "first", "last", "values", "values_list", "only", "count", "exists", "annotate", "order_by", "select_related", "prefetch_related", "raw", "extra", "defer", "distinct", "iterator"}
    loose = F.size(F.filter("steps", lambda s: s["method"].isin("filter", "exclude", "get") & F.exists(s["args"], lambda a: ~a.rlike(literal)))) + F.size(F.filter("steps", lambda s: s["method"].isin("raw", "extra") | ~s["method"].isin(*known)))
    like = F.exists(wanted, lambda a: a.rlike(r"__i?(contains|endswith)\s*=\s*[\"']"))
    django = make(
        "django", _QUERYSET, projection=F.when(has("count", "exists", "annotate"), "aggregate").when(has("values", "values_list", "only"), "columns").otherwise("unspecified"), per_outer_row=has("annotate"),
        has_where=has("filter", "exclude", "get", "raw", "extra"), where_depth=F.when(F.size(wanted) > 1, 2).when(F.size(wanted) == 1, 1).otherwise(0), like_leading=like, n_joins=F.size(args("select_related")),
        row_limit=F.when(has("first", "get", "exists"), 1).cast("bigint"), ordered=has("order_by"), fidelity=F.when(loose <= 0, "concrete").when(loose == 1, "partial").otherwise("skeletal"),
    )
    where = has("where", "filter", "filter_by")
    sqlalchemy = make("sqlalchemy", _has("select", "query"), projection=F.when(has("count"), "aggregate").otherwise("unspecified"), has_where=where, where_depth=where.cast("int"), row_limit=number(("limit",)), row_offset=number(("offset",)), ordered=has("order_by"), fidelity=F.when(where, "partial").otherwise("concrete"))
    verbs = lambda names: F.coalesce(*[F.when(F.col("last_method").rlike(f"^{p}"), o) for p, o in names])
    crud = verbs([("(find|count|aggregate|group|get|load|query)", "select"), ("(create|insert|save|persist|bulkCreate|upsert|Create|Save)", "insert"), ("(update|Update|merge|Updates)", "update"), ("(delete|destroy|remove|softDelete|Delete)", "delete")])
    prisma_args = F.array_join(F.flatten("steps.args"), " ")
    prisma = make(
        "prisma", "last_method IN ('findUnique', 'findFirst', 'findMany', 'create', 'createMany', 'update', 'updateMany', 'delete', 'deleteMany', 'upsert', 'count', 'aggregate') AND size(steps) >= 2",
        op=crud, projection=F.when(F.col("last_method").isin("count", "aggregate"), "aggregate").otherwise("full"), has_where=F.contains(prisma_args, F.lit("where")), where_depth=F.contains(prisma_args, F.lit("where")).cast("int"),
        row_limit=F.when(F.col("last_method") == "findUnique", 1).otherwise(keyed("take")), row_offset=keyed("skip"), ordered=F.contains(prisma_args, F.lit("orderBy")), fidelity=F.lit("partial"),
    )
    last_verb = F.element_at(F.filter("methods", lambda m: m.isin("select", "insert", "update", "delete")), -1)
    drizzle = make("drizzle", f"{_has('select', 'insert', 'update', 'delete')} AND {_has('from', 'into', 'values', 'set', 'where')}", op=last_verb, has_where=has("where"), where_depth=has("where").cast("int"), row_limit=number(("limit",)), ordered=has("orderBy"), fidelity=F.lit("partial"))
    by = F.col("last_method").isin("findBy", "findOneBy")
    typeorm = make("typeorm", f"{_REPO} AND last_method RLIKE '^(find|save|update|delete|insert|remove|count)'", op=crud, has_where=by, where_depth=by.cast("int"))
    sequelize = make("sequelize", _MODEL, op=crud)
    jpa_by = F.col("last_method").rlike("^findBy|^findById$")
    jpa = make("jpa", f"{_JPA_REPO} AND last_method RLIKE '^(find|get|save|persist|merge|delete|remove|count|exists)'", op=F.coalesce(crud, F.lit("select")), has_where=jpa_by, where_depth=jpa_by.cast("int"))
    gorm = make("gorm", f"{_GORM_DB} AND last_method RLIKE '^(First|Take|Last|Find|Create|Save|Update|Updates|Delete|Count|Scan|Pluck)$'", op=F.coalesce(crud, F.lit("select")))
    out = django
    for part in (sqlalchemy, prisma, drizzle, typeorm, sequelize, jpa, gorm):
        out = out.unionByName(part)
    return out


# Weight of a prediction's fidelity for each kind of rule.
WEIGHTS = {
    "default": {"concrete": 1.00, "partial": 0.60, "skeletal": 0.30},
    "taint": {"concrete": 1.00, "partial": 0.95, "skeletal": 0.70},
    "literal": {"concrete": 1.00, "partial": 0.30, "skeletal": 0.05},
    "cardinality": {"concrete": 1.00, "partial": 0.50, "skeletal": 0.10},
    "shape": {"concrete": 1.00, "partial": 0.80, "skeletal": 0.50},
}
# Fixed values: (id, severity, effort, base confidence, weights, predicate).
IR_RULES = [
    ("SQLIR-001", "medium", "small", 0.85, "shape", "op = 'select' AND projection = 'full'"),
    ("SQLIR-002", "high", "small", 0.95, "shape", "op IN ('update', 'delete') AND NOT has_where"),
    ("SQLIR-003", "low", "small", 0.80, "shape", "op = 'insert' AND projection = 'full'"),
    ("SQLIR-004", "high", "small", 0.95, "literal", "like_leading"),
    ("SQLIR-005", "medium", "small", 0.85, "shape", "row_limit IS NOT NULL AND NOT ordered"),
    ("SQLIR-006", "low", "medium", 0.65, "default", "where_or"),
    ("SQLIR-007", "medium", "medium", 0.70, "default", "where_function"),
    ("SQLIR-008", "low", "medium", 0.75, "shape", "where_depth > 3"),
    ("SQLIR-009", "high", "medium", 0.95, "shape", "cartesian OR (n_tables > 1 AND NOT has_where AND n_joins = 0)"),
    ("SQLIR-010", "medium", "small", 0.80, "shape", "op = 'update' AND row_limit IS NULL"),
    ("SQLIR-011", "high", "medium", 0.85, "cardinality", "projection = 'aggregate' AND per_outer_row"),
    ("SQLIR-012", "medium", "small", 0.85, "shape", "op = 'select' AND NOT has_where AND row_limit IS NULL"),
    ("SQLIR-013", "high", "medium", 0.95, "literal", "row_offset >= 1000"),
    ("SQLIR-014", "high", "medium", 0.95, "shape", "join_without_on"),
]


def apply_ir_rules(predicted: DataFrame) -> DataFrame:
    """The rules that fire on predicted statements; confidence is the base times the weight of the prediction's fidelity."""
    cases = []
    for id_, severity, effort, base, profile, when in IR_RULES:
        weight = F.create_map(*[F.lit(x) for p in WEIGHTS[profile].items() for x in p])[F.col("fidelity")]
        sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(base) * weight))
        cases.append(F.when(F.coalesce(F.expr(when), F.lit(False)), F.struct(F.lit(id_).alias("rule_id"), F.lit("sql_ir_antipattern").alias("kind"), F.lit(severity).alias("severity"), F.lit(effort).alias("effort"), sure.alias("confidence"))))
    return predicted.withColumn("__r", F.explode(F.array_compact(F.array(*cases)))).select("file", "line", "byte_start", "byte_end", "orm", "__r.*")


def render_sql(width: int = 200) -> Column:
    """A predicted statement as SQL-like text, cut to a width."""
    text = F.concat_ws(
        " ", F.upper("op"), F.when(F.col("projection") == "full", "*").when(F.col("projection") == "aggregate", "<aggregate>").otherwise("<columns>"), F.when(F.col("has_where"), "WHERE <condition>"),
        F.when(F.col("ordered"), "ORDER BY <keys>"), F.when(F.col("row_limit").isNotNull(), F.concat(F.lit("LIMIT "), F.col("row_limit").cast("string"))), F.when(F.col("row_offset").isNotNull(), F.concat(F.lit("OFFSET "), F.col("row_offset").cast("string"))),
    )
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 1)), F.lit("…"))).otherwise(text)


#: Bytes of code within which overlaps are looked for together.
BLOCK = 4096


def fuse(chain_findings: DataFrame, ir_findings: DataFrame) -> DataFrame:
    """Findings of both kinds, those on overlapping code merged: confidences by noisy-or, the higher severity.

    A finding on a predicted statement belongs to the first finding on a chain (by
    position, then rule) that overlaps it; those that overlap none stay by
    themselves. ``fused`` lists the rules taken in. Equal findings count once.
    """
    key = ["file", "byte_start", "byte_end", "line", "rule_id"]
    keep = [*key, "kind", "severity", "effort", "confidence"]
    first, second = chain_findings.select(*keep).dropDuplicates(key), ir_findings.select(*keep).dropDuplicates(key)
    blocks = F.explode(F.sequence(F.floor(F.col("byte_start") / BLOCK), F.floor(F.greatest("byte_end", "byte_start") / BLOCK)))
    a = first.select(F.col("file").alias("a_file"), blocks.alias("a_block"), F.struct("byte_start", "byte_end", "rule_id", "line").alias("a"))
    b = second.withColumn("block", blocks)
    over = (b["file"] == a["a_file"]) & (b["block"] == a["a_block"]) & (F.col("a.byte_start") < F.col("byte_end")) & (F.col("byte_start") < F.col("a.byte_end"))
    owned = b.join(a, over).groupBy(*keep).agg(F.min("a").alias("a"))
    rank = severity_rank(F.col("severity"))
    taken = owned.groupBy("file", "a").agg(F.sort_array(F.collect_list(F.struct("rule_id", (1 - F.col("confidence")).alias("doubt")))).alias("in"), F.max_by("severity", rank).alias("other"), F.max(rank).alias("other_rank"))
    taken = taken.select(F.col("file").alias("t_file"), "a", F.col("in.rule_id").alias("fused"), F.aggregate("in", F.lit(1.0), lambda x, y: x * y["doubt"]).alias("doubt"), "other", "other_rank")
    here = F.struct("byte_start", "byte_end", "rule_id", "line")
    none = F.array().cast("array<string>")
    merged = first.withColumn("__h", here).join(taken, (F.col("file") == F.col("t_file")) & (F.col("__h") == F.col("a")), "left").select(
        *key, "kind", F.when(F.col("other_rank") > rank, F.col("other")).otherwise(F.col("severity")).alias("severity"), "effort",
        (1 - (1 - F.col("confidence")) * F.coalesce("doubt", F.lit(1.0))).alias("confidence"), F.coalesce("fused", none).alias("fused"),
    )
    alone = second.join(owned.select(*key), key, "left_anti").select(*keep).withColumn("fused", none)
    return merged.unionByName(alone)


def scan_workspace(records: DataFrame) -> DataFrame:
    """All findings of all files. Extraction and the chain rows are stored once, as many branches read them."""
    rows = materialize(chain_rows(materialize(records, "records")), "chains")
    return fuse(materialize(apply_chain_rules(rows), "fired"), materialize(apply_ir_rules(predict(rows)), "predicted"))


def rule_histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id")


def scan_files(files: DataFrame) -> DataFrame:
    """The same from files (path, content), those left out unread in which no word of any track occurs."""
    from stackloom.sources import code

    return scan_workspace(code.extract(files.filter(may_concern(F.col("content")))))


def attach_findings(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Findings with the tree node they belong to (root, node_ord).

    Of the nodes of the same file whose lines hold a finding: module entries last,
    small entries first, the deepest node. Where none holds it, the first root of
    that file, else the first node of it; where no tree has the file, the file's
    own synthetic root, number 0 (``file_root`` of it).

    ``nodes``: root, node_ord, depth, file, line, loc, root_loc, root_is_module.
    """
    n = nodes.select(F.col("file").alias("n_file"), F.col("line").alias("n_line"), (F.col("line") + F.greatest("loc", F.lit(1))).alias("n_end"), "root", "node_ord", "depth", "root_loc", "root_is_module")
    held = n.withColumn("n_block", F.explode(F.sequence(F.floor(F.col("n_line") / 128), F.floor(F.col("n_end") / 128))))  # lines are matched within blocks
    hit = findings.join(held, (F.col("file") == F.col("n_file")) & (F.floor(F.col("line") / 128) == F.col("n_block")) & F.col("line").between(F.col("n_line"), F.col("n_end")), "left")
    order = F.struct("root_is_module", "root_loc", (-F.col("depth")).alias("d"), "root", "node_ord")
    keys = [c for c in findings.columns if c != "fused"]
    got = hit.groupBy(*keys).agg(F.min_by(F.struct("root", "node_ord"), order).alias("__n"))
    first = n.groupBy("n_file").agg(F.min_by(F.struct("root", "node_ord"), F.struct((F.col("node_ord") != 0).alias("inner"), "root", "node_ord")).alias("__f"))
    got = got.join(first, got["file"] == first["n_file"], "left").withColumn("__n", F.when(F.col("__n.root").isNotNull(), F.col("__n")).otherwise(F.col("__f")))
    return got.select(*keys, F.coalesce("__n.root", file_root(F.col("file"))).alias("root"), F.coalesce("__n.node_ord", F.lit(0)).cast(dict(nodes.dtypes)["node_ord"]).alias("node_ord"))


def file_root(file: Column) -> Column:
    """Id of the synthetic root of a file that no tree has."""
    return F.concat_ws("::", file, F.lit("<orm_file>"), F.substring_index(file, "/", -1))
