import json

from riskweave.cli import main
from riskweave.plans.keystone import keystone_paths


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "app").mkdir()
    (tmp_path / "app" / "page.tsx").write_text("export default () => eval(x)\n")
    assert main(["scan", str(tmp_path), "--format", "json"]) == 1
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["rule_id"] == "injection.eval"
    assert main(["scan", str(tmp_path), "--write-baseline", str(tmp_path / "base")]) == 1
    assert main(["scan", str(tmp_path), "--baseline", str(tmp_path / "base")]) == 0
    assert main(["scan", str(tmp_path), "--override", "injection.eval=low", "--format", "sarif"]) == 0
    assert '"level":"note"' in capsys.readouterr().out
    assert main(["rules"]) == 0 and main(["explain", "injection.eval"]) == 0 and main(["explain", "nope"]) == 2
    (tmp_path / "a.log").write_text('{"ts":"2024-01-01T00:00:00Z","ip":"1","path":"/","status":500}\n')
    assert main(["logs", str(tmp_path / "a.log")]) == 0
    assert "verbose-error" in capsys.readouterr().out


def test_fix(spark, tmp_path, capsys):
    page, other = tmp_path / "app" / "page.tsx", tmp_path / "app" / "other.tsx"
    page.parent.mkdir()
    text = "export default () => (\n  <a target='_blank'>é</a>\n)"
    page.write_text(text)
    page.chmod(0o640)
    other.write_bytes(b"// \xff\nconst a = <a target='_blank'>x</a>\n")
    assert main(["fix", str(tmp_path), "--dry-run"]) == 0 and page.read_text() == text
    shown = capsys.readouterr().out
    assert "+++ b/app/page.tsx" in shown and "+  <a target='_blank' rel=\"noopener noreferrer\">é</a>\n" in shown
    assert main(["fix", str(tmp_path)]) == 0
    assert page.read_text() == text.replace("k'>", "k' rel=\"noopener noreferrer\">") and page.stat().st_mode & 0o777 == 0o640
    assert other.read_bytes().endswith(b"target='_blank'>x</a>\n")
    capsys.readouterr()
    assert main(["fix", str(tmp_path), "--dry-run"]) == 0 and "page.tsx" not in capsys.readouterr().out


def test_keystone(spark, tmp_path):
    schema = "file string, ext string, text string"
    safe = [("app/api/x/route.ts", "ts", "export async function POST(r) { return 1 }"), ("lib/k.ts", "ts", "export const api_key = 'abcdefghijklmnop'")]
    risky = [("app/api/x/route.ts", "ts", "import { k } from '../../../lib/k'\nexport async function POST(r) { return eval(r) }"), safe[1]]
    changed = spark.createDataFrame([("app/api/x/route.ts", 2)], "file string, line int")
    blame = spark.createDataFrame([("app/api/x/route.ts", 2, "someone")], "file string, line int, author string")
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = keystone_paths(spark.createDataFrame(safe, schema), spark.createDataFrame(risky, schema), changed=changed, blame=blame).collect()
    assert [r.kind for r in rows] == ["secret-pivot"]
    assert {(s.file, s.introduced, s.author) for s in rows[0].steps} == {("app/api/x/route.ts", True, "someone"), ("lib/k.ts", False, None)}
    assert keystone_paths(spark.createDataFrame(risky, schema), spark.createDataFrame(risky, schema)).collect() == []
