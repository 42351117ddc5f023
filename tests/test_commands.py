"""Commands: what they print, their errors and exit codes."""

import json

import pytest

from loomtrace import commands
from loomtrace.operators.json_schema import SchemaError

DIGEST = "04be681019222236d75410d33fcd240d318d862bd3770b6f44f7c5c6781ce887"


@pytest.fixture
def run(spark, capsys):
    def call(*argv):
        code = commands.main(list(map(str, argv)), spark)
        out, err = capsys.readouterr()
        return code, json.loads(out) if out else None, err.strip()

    return call


def test_simulate_validate_replay(run, tmp_path):
    code, made, _ = run("simulate", "--scenario", "cold-start-idle", "--output", tmp_path / "b")
    assert code == 0 and (made["records"], made["semantic_digest"]) == (17, DIGEST)
    assert run("validate-bundle", tmp_path / "b") == (0, {"valid": True, "capture_id": made["capture_id"], "observations": 17, "semantic_digest": DIGEST}, "")
    code, out, _ = run("replay", tmp_path / "b", "--output", tmp_path / "samples")
    assert code == 0 and (out["observations"], out["signal_samples"], len(out["signal_ids"])) == (17, 68, 4)
    lines = [x for p in sorted((tmp_path / "samples").glob("part-*")) for x in p.read_text().splitlines()]
    assert len(lines) == 68 and list(json.loads(lines[0])) == sorted(json.loads(lines[0]))
    code, out, err = run("replay", tmp_path / "b", "--output", tmp_path / "samples")
    assert (code, out) == (2, None) and err.startswith("error: ") and "there already" in err
    code, out, err = run("simulate", "--scenario", "cold-start-idle", "--output", tmp_path / "b")
    assert (code, out) == (2, None) and "there already" in err


def test_broken_bundle(run, tmp_path):
    run("simulate", "--scenario", "cold-start-idle", "--output", tmp_path / "b")
    path = tmp_path / "b" / "observations.ndjson"
    path.write_bytes(path.read_bytes().replace(b'"quality":"GOOD"', b'"quality":"BEST"', 1))
    (tmp_path / "b" / ".observations.ndjson.crc").unlink(missing_ok=True)
    code, out, err = run("validate-bundle", tmp_path / "b")
    assert (code, out) == (2, None) and err.startswith("error: ") and "hash" in err and "\n" not in err
    code, out, err = run("validate-bundle", tmp_path / "none")
    assert (code, out) == (2, None) and "no manifest.json" in err


def test_contracts_check(run, tmp_path):
    (tmp_path / "s").mkdir()
    good = {"$id": "urn:x/a", "type": "object", "properties": {"n": {"type": "integer"}}}
    (tmp_path / "s" / "a.schema.json").write_text(json.dumps(good))
    code, out, _ = run("contracts", "check", "--schemas", tmp_path / "s")
    assert code == 0 and out["valid"] and out["schema_count"] == len(out["schemas"]) == 1
    (tmp_path / "s" / "b.schema.json").write_text(json.dumps({"$id": "urn:x/b", "type": "thing"}))
    code, out, err = run("contracts", "check", "--schemas", tmp_path / "s")
    assert (code, out) == (2, None) and err.startswith("error: ") and issubclass(SchemaError, ValueError)


def test_usage():
    for argv in ([], ["other"], ["replay"], ["simulate", "--scenario", "x", "--output", "y"]):
        with pytest.raises(SystemExit) as e:
            commands.main(argv)
        assert e.value.code == 2
