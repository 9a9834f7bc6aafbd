import json

from gatewright.__main__ import main
from gatewright.plans.catalog import EXPERIMENT


def test_check_prepare_run(spark, tmp_path, capsys):
    one = {**EXPERIMENT, "product": [[{"learner": {"name": "split"}}], [{"sampling": {"Ne": 8}}]]}
    path = tmp_path / "e.yaml"
    path.write_text(json.dumps(one))  # JSON is YAML
    assert main(["check", str(path)]) == 0 and "1 configurations" in capsys.readouterr().out
    (tmp_path / "bad.yaml").write_text(json.dumps({**one, "base_config": {}}))
    assert main(["check", str(tmp_path / "bad.yaml")]) == 1
    assert main(["prepare", str(path), str(tmp_path / "f")]) == 0
    assert main(["run", str(tmp_path / "f"), "--range", "0", "1"]) == 0
    assert main(["run", str(tmp_path / "f")]) == 0 and "2 results" in capsys.readouterr().out
