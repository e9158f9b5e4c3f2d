import pytest

from stackloom.lint import chainrules as C, sqlrules as S
from stackloom.lint.sqlparse import SqlError, parse, split_statements
from stackloom.plans.profile_queries import _STATEMENTS
from stackloom.plans.profile_sql import _LINT
from stackloom.sources import code

MORE = [
    ("SELECT a FROM t WHERE b LIKE 'x%' AND c IS NOT NULL", set()), ("SELECT a, b FROM t, u WHERE t.x = u.x", set()), ("SELECT t.* FROM t", set()), ("DELETE FROM t WHERE a = 1", set()), ("UPDATE t SET a = 1 WHERE b = 2", set()),
    ("INSERT INTO t (a) VALUES (1)", set()), ("INSERT INTO t SELECT a FROM u", set()), ("SELECT a FROM t UNION ALL SELECT b FROM u", set()), ("CREATE INDEX CONCURRENTLY i ON t (a)", set()),
    ("ALTER TABLE t ADD COLUMN a int NOT NULL DEFAULT 0", set()), ("ALTER TABLE t ADD CONSTRAINT f FOREIGN KEY (a) REFERENCES b (c) NOT VALID", set()), ("ALTER TABLE t DROP CONSTRAINT x", set()),
    ("SELECT sum(a) OVER (PARTITION BY b ORDER BY c), rank() OVER (PARTITION BY b ORDER BY c) FROM t", set()), ("SELECT a FROM t GROUP BY a HAVING count(*) > 1", set()),
    ("WITH x AS (SELECT * FROM y) SELECT a::int, b ->> 'k' FROM x WHERE a BETWEEN 1 AND 2 AND EXISTS (SELECT 1 FROM z) ORDER BY a LIMIT 3", set()),
]


def test_every_statement_rule_and_its_opposite(spark):
    fires = {int(row.split()[0]): {row.split()[1]} for row in _LINT.strip().splitlines()}
    cases = [(s.replace("{k}", "7"), fires.get(i, set())) for i, s in enumerate(_STATEMENTS)] + MORE
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, sql string")
    got: dict = {i: set() for i in range(len(cases))}
    for r in S.apply_rules(S.statement_features(df)).collect():
        got[r["i"]].add(r["rule_id"])
    assert {cases[i][0]: v for i, v in got.items()} == {s: ids for s, ids in cases}
    assert {x for _, ids in cases for x in ids} == {r.id for r in S.RULES}


def test_scripts_are_split_with_lines():
    text = "-- first; not here\nSELECT 1;\n\n/* a; b */ SELECT ';' AS x ;\nCREATE FUNCTION f() AS $b$ x; y $b$;\n  \n-- end"
    assert split_statements(text) == [(2, "SELECT 1"), (4, "SELECT ';' AS x"), (5, "CREATE FUNCTION f() AS $b$ x; y $b$")]


@pytest.mark.parametrize("text", ["", "hello", "SELECT FROM WHERE", "SELECT (1", "SELECT 1 2 3 )", "((((", "SELECT a FROM t WHERE"])
def test_unparsable_texts_are_silent(text):
    assert S.features(text) is None
    with pytest.raises((SqlError, IndexError)):
        parse(text)


def test_files(spark):
    files = spark.createDataFrame([("a.sql", "\\set x 1\nSELECT *\nFROM t;\n\nDELETE FROM t;"), ("dbt.sql", "SELECT * FROM {{ ref('x') }}"), ("bad.sql", "what is this"), ("none.sql", None), ("blank.sql", "")], "path string, content string")
    assert {(r["path"], r["line"], r["rule_id"]) for r in S.lint_files(files).collect()} == {("a.sql", 2, "SQL001"), ("a.sql", 5, "SQL002"), ("bad.sql", 1, "SQL_UNPARSABLE")}


PYTHON = """
from django.db import models
from sqlalchemy.orm import joinedload
import bcrypt, rsa
from openai import OpenAI

class Team(models.Model):
    members = models.ManyToManyField(User)
    lead = models.ForeignKey(User, on_delete=1)

client = OpenAI()
def f(ids):
    qs = User.objects.filter(name__contains="x")
    if qs.count():
        pass
    for u in qs:
        u.profile.name.upper()
        u.save()
        Log.objects.create(a=u)
        session.add(u)
        session.execute(select(User))
        OpenAI()
        client.chat.completions.create(model="m")
        bcrypt.hashpw(u, b"")
    len(qs)
    bool(qs)
    User.objects.prefetch_related("x").iterator()
    Team.objects.values("members")
    User.objects.raw(f"select {ids}")
    Paginator(qs, 5).page(2)
    q.options(joinedload(Team.members)).yield_per(5)
    rows = session.query(User).all()
    len(rows)
    relationship("X", lazy="dynamic")
    session.execute(text(f"select {ids}"))
    rsa.generate_private_key(65537)
    requests.get("https://x/.well-known/jwks.json")
    client.messages.create(system="x")
async def g():
    client.chat.completions.create(model="m")
def h():
    found = session.execute(select(User))
    for r in found:
        print(r.a)
def k(users):
    for order in users:
        order.lead.name.lower()
"""
TYPESCRIPT = """
import { PrismaClient } from '@prisma/client';
import { drizzle } from 'drizzle-orm';
import { DataSource } from 'typeorm';
import { Sequelize } from 'sequelize';
import mongoose from 'mongoose';
const ds = new DataSource({ synchronize: true });
class A {
  @OneToMany(() => B, b => b.a, { eager: true })
  bs: B[];
}
export async function run(ids: number[]) {
  for (const id of ids) {
    await db.user.findUnique({ where: { id } });
    await db.select().from(users).where(eq(users.id, id));
    await userRepo.findOne({ where: { id } });
    await User.findByPk(id);
    await user.save();
    await User.findById(id);
    user.toObject();
  }
  const rows = await db.select().from(users).limit(5);
  console.log(rows.length());
  await db.user.findMany({ skip: 5000, include: { a: { include: { b: { include: { c: true } } } } } });
  await db.$queryRawUnsafe(`select ${ids}`);
  await repo.createQueryBuilder('u').where(`u.id = ${ids}`).getMany();
  await sequelize.query(`select ${ids}`);
  await sequelize.sync({ force: true });
  await Post.find().populate('a').populate('b').populate('c');
  await User.find({ $where: `this.a == ${ids}` });
}
"""
JAVA = """
import javax.persistence.Entity;
public class S {
  @OneToMany(fetch = FetchType.EAGER)
  private List<A> as;
  @Query("select u from U where u.id = " + ID)
  public void run(List<Long> ids) {
    for (Long id : ids) {
      userRepository.findById(id);
      userRepository.save(id);
    }
  }
}
"""
GO = """package a
import (
  "gorm.io/gorm"
)
func (s *Svc) Load(ids []int) error {
  for _, id := range ids {
    s.db.Where("id = ?", id).First(&u)
    db.Create(&u)
  }
  db.Raw(fmt.Sprintf("select %d", 1)).Scan(&u)
  db.AutoMigrate(&U{})
  return nil
}
"""
RUST = """
use sqlx::PgPool;
async fn load(pool: &PgPool, ids: Vec<i32>) {
    for id in ids {
        sqlx::query("select a from t where id = $1").bind(id).fetch_one(pool).await;
    }
    sqlx::query(&format!("select {}", 1)).fetch_all(pool).await;
}
"""


@pytest.fixture(scope="module")
def scanned(spark):
    files = spark.createDataFrame([("a.py", PYTHON), ("b.ts", TYPESCRIPT), ("c.java", JAVA), ("d.go", GO), ("e.rs", RUST), ("bad.py", "def ("), ("none.py", None), ("x.txt", "db.save()")], "path string, content string")
    records = code.extract(files).cache()
    return records, C.chain_rows(records).cache()


def test_every_chain_rule_fires(scanned):
    fired = {r["rule_id"] for r in C.apply_chain_rules(scanned[1]).collect()}
    assert {r.id for r in C.RULES} - fired == set()


def test_clean_files_are_silent(spark):
    files = spark.createDataFrame([("a.py", "import json\ndef f(x):\n    return json.loads(x).get('a')\n"), ("b.go", "package a\nfunc f() int {\n  return g(1)\n}\n")], "path string, content string")
    assert C.apply_chain_rules(C.chain_rows(code.extract(files))).collect() == []


def test_predictions_and_fusion(scanned):
    rules = {r["rule_id"] for r in C.apply_ir_rules(C.predict(scanned[1])).collect()}
    assert {"SQLIR-001", "SQLIR-004", "SQLIR-005", "SQLIR-012", "SQLIR-013"} <= rules
    merged = C.scan_workspace(scanned[0]).collect()
    one = next(r for r in merged if r["rule_id"] == "PRI-N1-002")
    assert one["fused"] == ["SQLIR-001", "SQLIR-005"] and one["confidence"] == pytest.approx(1 - 0.1 * (1 - 0.68) ** 2)
    assert sum(1 + len(r["fused"]) for r in merged) == C.apply_chain_rules(scanned[1]).count() + C.apply_ir_rules(C.predict(scanned[1])).count()


def test_ir_rules_over_values(spark):
    base = {"file": "f", "line": 1, "byte_start": 0, "byte_end": 1, "orm": "x", "op": "select", "n_tables": 1, "projection": "columns", "per_outer_row": False, "has_where": True, "where_or": False, "where_function": False, "where_depth": 1, "like_leading": False,
            "n_joins": 0, "cartesian": False, "join_without_on": False, "row_limit": 1, "row_offset": None, "ordered": True, "in_loop": False, "fidelity": "concrete"}
    change = {"SQLIR-002": {"op": "delete", "has_where": False}, "SQLIR-003": {"op": "insert", "projection": "full"}, "SQLIR-006": {"where_or": True}, "SQLIR-007": {"where_function": True}, "SQLIR-008": {"where_depth": 4}, "SQLIR-009": {"cartesian": True},
              "SQLIR-010": {"op": "update", "row_limit": None}, "SQLIR-011": {"projection": "aggregate", "per_outer_row": True}, "SQLIR-014": {"join_without_on": True}}
    rows = [{**base, "file": k, **v} for k, v in change.items()] + [base]
    got = {(r["file"], r["rule_id"]) for r in C.apply_ir_rules(spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in C.PREDICTED.split(", ")) for r in rows], C.PREDICTED)).collect()}
    assert got == {(k, k) for k in change}


def test_symbols_of_each_language(scanned):
    got = {(r["file"], r["name"], r["kind"]) for r in scanned[0].filter("record_kind = 'symbol'").collect()}
    assert {("a.py", "f", "Function"), ("a.py", "Team", "Class"), ("b.ts", "run", "Function"), ("b.ts", "A", "Class"), ("c.java", "run", "Method"), ("c.java", "S", "Class"), ("d.go", "Load", "Method"), ("e.rs", "load", "Function")} <= got
