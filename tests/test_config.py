import gzip
import json

import pytest

from quillmesh import cli, config


def write(tmp_path, text):
    file = tmp_path / "c.yaml"
    file.write_text(text)
    return file


def test_defaults_then_file_then_call(tmp_path):
    none = tmp_path / "none.yaml"
    assert config.load(user_file=none).query_k == 20
    file = write(tmp_path, "query_k: 7\nexplain_hops: 1\nllm_model: m\n")
    have = config.load(file, user_file=none, explain_hops=2, query_hops=None)
    assert (have.query_k, have.explain_hops, have.query_hops, have.embedding_model) == (7, 2, 1, "m")
    assert config.load(user_file=file).query_k == 7
    empty = tmp_path / "empty.yaml"
    empty.write_text("")
    assert config.load(empty, user_file=file).query_k == 20  # a named file stands in for the user's


@pytest.mark.parametrize("text", ["query_k: 201", "query_k: 0", "explain_hops: 3", "compress: 1", "languages: [klingon]", "languages: python", "max_non_code_share: 0",
                                  "path_provenance_inferred_factor: 0", "large_repo_policy: maybe", "output: '  '", "- 1", "a: [", "ignored_patterns: [1]"])
def test_bad_values(tmp_path, text):
    with pytest.raises(config.ConfigError):
        config.load(write(tmp_path, text))


def test_missing_and_unknown(tmp_path):
    with pytest.raises(config.ConfigError):
        config.load(tmp_path / "none.yaml")
    with pytest.warns(UserWarning, match="odd"):
        config.load(write(tmp_path, "odd: 1"))


def test_ignores():
    plain = config.load(user_file="/nonexistent")
    assert "docs/" not in config.ignores(plain)
    code = config.load(user_file="/nonexistent", code_only=True, ignored_patterns=["docs/", "x/"])
    assert config.ignores(code)[:2] == ["docs/", "x/"] and config.ignores(code).count("docs/") == 1
    assert config.ignores(config.load(user_file="/nonexistent", code_only=True, include_generated_docs=True)) == list(plain.ignored_patterns)


def test_template(tmp_path):
    file = config.write_template(tmp_path / "deep" / "c.yaml")
    with pytest.raises(config.ConfigError):
        config.write_template(file)
    file.write_text(file.read_text().replace("\n# ", "\n"))
    assert vars(config.load(file)) == vars(config.load(user_file="/nonexistent"))


def test_command_line(spark, tmp_path):
    spark.range(1).count()
    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    (root / "src" / "app.py").write_text("def greet():\n    return 1\n")
    (root / "skip.me").write_text("x")
    file = write(tmp_path, f"output: {tmp_path}/out/graph.json\nignored_patterns: ['*.me']\nversioned: true\ncompress: true\n")
    assert cli.main(["index", str(root), "--config", str(file)]) == 0
    with gzip.open(tmp_path / "out" / "graph_v1.json.gz") as f:
        ids = {n["id"] for n in json.load(f)["nodes"]}
    assert "src/app.py::function::greet::1" in ids and "skip.me" not in ids
    assert cli.main(["status", "--config", str(tmp_path / "none.yaml")]) == 2
    limit = write(tmp_path, f"output: {tmp_path}/g.json\nmax_file_count: 1\n")
    assert cli.main(["index", str(root), "--config", str(limit)]) == 2
