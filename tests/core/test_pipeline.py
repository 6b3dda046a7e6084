from pyspark.sql import functions as F

from tessera.config import Settings, resolve
from tessera.operators import drift
from tessera.plans.pipeline import Engine

FILES = {
    "auth.py": 'def hash_password(password, salt):\n    """Hashes a password with its salt."""\n    return digest(password + salt)\n\n\ndef digest(text):\n    """Digests a text to hex."""\n    return text.encode("utf-8").hex()\n',
    "router.py": "from auth import hash_password\n\n\ndef handle_route(path, user):\n    return resolve(path) + hash_password(user, path)\n\n\ndef resolve(path):\n    parts = path.split('/')\n    return [part for part in parts if part]\n",
    "vendor/skip.py": "def skipped(a, b, c):\n    return a + b + c\n",
    "README.md": "handle_route returns resolve of the path.\n",
}


def _engine(spark, tmp_path):
    root = tmp_path / "demo"
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    engine = Engine(spark, str(tmp_path / "data"), Settings(min_tokens=5))
    return engine, engine.index(str(root), "demo").first()


def test_index_ask_drift(spark, tmp_path):
    engine, stats = _engine(spark, tmp_path)
    assert (stats.num_files, stats.num_chunks, stats.languages) == (2, 4, "python")
    first = {r.chunk_id for r in engine.table("chunks").collect()}
    engine.index(str(tmp_path / "demo"), "demo")
    assert {r.chunk_id for r in engine.table("chunks").collect()} == first  # the same again
    assert engine.repos().first().status == "ready"
    q = spark.createDataFrame([(1, "resolve the path of a route"), (2, "hash password salt")], "query_id long, text string")
    got = {(r.query_id, r.symbol_name) for r in engine.context(q).collect()}
    assert {(1, "resolve"), (2, "hash_password")} <= got
    claims = spark.createDataFrame([(1, "handle_route returns resolve of the path", "README.md", 1)], "claim_id long, claim string, doc_file string, doc_line long")
    finding = engine.drift(claims).first()
    assert finding.status == "supported" and finding.code_file == "router.py"


def test_answers_are_asked_for_again(spark, tmp_path):
    engine, _ = _engine(spark, tmp_path)
    q = spark.createDataFrame([(1, "resolve path"), (2, "hash password")], "query_id long, text string")
    rounds = []

    def model(prompts):
        rounds.append(prompts.count())
        cite = "[router.py:8-10]" if len(rounds) > 1 else "[router.py:999]"
        return prompts.select("answer_id", F.when(F.col("answer_id") == 2, "NOT_FOUND_IN_CODEBASE").otherwise(f"parts path split {cite}").alias("text"))

    got = {r.answer_id: r.ok for r in engine.answer(q, model).collect()}
    assert got == {1: True, 2: True} and rounds == [2, 1]


def test_citations_of_all_lines_and_cited_premises(spark, tmp_path):
    root = tmp_path / "cited"
    root.mkdir()
    (root / "router.py").write_text(FILES["router.py"] + "\n# the table of routes\n# ends here\n")
    (root / "auth.py").write_text(FILES["auth.py"])
    (root / "small.py").write_text("LIMIT = 3\n")
    (root / "NOTES.md").write_text("one\ntwo\n")
    engine = Engine(spark, str(tmp_path / "index"), Settings(min_tokens=5))
    engine.index(str(root), "cited")
    assert engine.table("chunks").where("file_path = 'router.py'").agg(F.max("end_line")).first()[0] < 13
    said = [(1, "resolve path [router.py:12-13]"), (2, "resolve path [small.py:1-1]"), (3, "resolve path [NOTES.md:2]"), (4, "resolve path [router.py:14]"), (5, "resolve path [small.py:2]"), (6, "parts path split. [auth.py:6-7]"), (7, "parts path split. [small.py:1]")]
    q = spark.createDataFrame([(n, "resolve path split parts hash digest") for n, _ in said], "query_id long, text string")
    answers = spark.createDataFrame(said, "answer_id long, text string")
    got = {r.answer_id: r for r in engine.answer(q, lambda prompts: prompts.select("answer_id").join(answers, "answer_id"), attempts=0).collect()}
    assert {n: r.ok for n, r in got.items()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True, 7: True}
    assert got[6].score < got[7].score  # 6 cites a chunk that doesn't say it, 7 none, so all of its context counts


def test_repositories_side_by_side(spark, tmp_path):
    engine, _ = _engine(spark, tmp_path)
    first = {r.chunk_id for r in engine.table("chunks").collect()}
    other = tmp_path / "other"
    other.mkdir()
    (other / "box.py").write_text("def open_box(lid, key):\n    return lid.turn(key)\n")
    asked = []
    encode = engine.encode
    again = Engine(spark, engine.data_dir, engine.settings, encode=lambda c: asked.append(1) or encode(c))
    again.index(str(other), "007")
    assert {r.chunk_id for r in again.table("chunks", "demo").collect()} == first and {r.repo_id for r in again.table("chunks").collect()} == {"demo", "007"}
    q = spark.createDataFrame([(1, "open box lid"), (2, "  ")], "query_id long, text string")
    assert {r.symbol_name for r in again.context(q, repo_id="007").collect()} == {"open_box"} and "open_box" in {r.symbol_name for r in again.context(q).collect()}
    (tmp_path / "demo" / "router.py").unlink()
    again.index(str(tmp_path / "demo"), "demo")
    left = {r.chunk_id for r in again.table("chunks", "demo").collect()}
    assert left < first and {r.id for r in again.table("vectors", "demo").collect()} == left
    assert again.delete("demo") and not again.delete("demo") and {r.id for r in again.repos().collect()} == {"007"}
    assert {r.repo_id for r in again.table("postings").select("repo_id").distinct().collect()} == {"007"}


def test_drift_from_documents(spark, tmp_path):
    engine, _ = _engine(spark, tmp_path)
    stages = []
    engine = Engine(spark, engine.data_dir, engine.settings, progress=lambda stage, message: stages.append(stage))
    (tmp_path / "demo" / "vendor" / "OTHER.md").write_text("ignored\n")
    (tmp_path / "demo" / "empty.txt").write_text("\n")
    (tmp_path / "demo" / "notes.RST").write_text("one\ntwo\n")

    def model(asked):
        rows = {r.prompt for r in asked.collect()}
        assert any("1: handle_route returns resolve of the path." in x for x in rows) and any("1: one\n2: two" in x for x in rows) and len(rows) == 2
        readme = 'Sure: [{"claim": "handle_route returns resolve of the path", "line": 9}, {"claim": " "}, {"claim": "qwxy zzq bbvn", "line": 1}]'
        return asked.select("answer_id", F.when(F.col("prompt").contains("README"), readme).otherwise("none").alias("text"))

    assert engine.latest_report("demo") is None
    found = {r.claim: r for r in engine.check_documents(str(tmp_path / "demo"), "demo", model).collect()}
    good = found["handle_route returns resolve of the path"]
    assert (good.status, good.code_file, good.doc_file, good.doc_line) == ("supported", "router.py", "README.md", 1) and len(found) == 2 and stages == ["extract", "check", "done"]
    assert engine.latest_report("demo").count() == 2 and engine.latest_report("demo", "supported").count() == 1
    report = drift.markdown(engine.latest_report("demo"), "demo")
    assert report.startswith("# Documentation Drift Report — demo") and "`README.md:1`" in report and report.index("## Contradicted") < report.index("## Supported")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from tessera import __main__ as cli

    _engine(spark, tmp_path)
    monkeypatch.setattr(cli, "get_spark", lambda app: spark)
    at = ["--data", str(tmp_path / "data"), "--repo", "demo"]
    assert cli.main([*at, "ask", "resolve the path of a route"]) == 0
    said = capsys.readouterr().out
    assert "[router.py:" in said or "[auth.py:" in said
    claims = tmp_path / "claims.json"
    claims.write_text('{"claim": "qwxy zzq", "doc_file": "README.md", "doc_line": 1}\n')
    assert cli.main([*at, "drift", str(tmp_path / "demo"), "--claims", str(claims), "--ci"]) == 1
    assert "## Contradicted (1)" in capsys.readouterr().out


def test_settings_of_files(monkeypatch, tmp_path):
    (tmp_path / "home").mkdir()
    (tmp_path / "home" / "tessera.toml").write_text("max_tokens = 50\noverlap = 5\nhops = 3\n")
    (tmp_path / "tessera.toml").write_text('[tessera]\nmax_tokens = 60\noverlap = 6\nignore = ["a/", "b"]\n')
    (tmp_path / ".env").write_text("# note\nTESSERA_MAX_TOKENS=70\n")
    s = resolve(project=tmp_path, user=tmp_path / "home")
    assert (s.max_tokens, s.overlap, s.hops, s.ignore) == (70, 6, 3, ("a/", "b"))
    monkeypatch.setenv("TESSERA_MAX_TOKENS", "80")
    assert resolve(project=tmp_path, user=tmp_path / "home").max_tokens == 80


def test_settings(monkeypatch, spark):
    monkeypatch.setenv("TESSERA_MAX_TOKENS", "99")
    monkeypatch.setenv("TESSERA_LANGUAGES", "go, rust")
    spark.conf.set("tessera.overlap", "7")
    s = resolve(spark, min_tokens=3)
    assert (s.max_tokens, s.languages, s.overlap, s.min_tokens, s.hops) == (99, ("go", "rust"), 7, 3, 1)
    spark.conf.unset("tessera.overlap")
