"""The command line over a small workspace."""

import json

from corpuscope.__main__ import main


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.php").write_text("<?php\ndeclare(strict_types=1);\n$a = eval('1');\nvar_dump($a);\n")
    (tmp_path / "src/b.php").write_text("<?php\ndeclare(strict_types=1);\nbreak;\n$x = new Gone();\n")

    def run(*argv):
        code = main([*argv], spark)
        return code, capsys.readouterr().out

    here = ("--workspace", str(tmp_path))
    assert run("list-files", "src", *here) == (0, "src/a.php\nsrc/b.php\n")
    code, out = run("lint", "src", *here, "--only", "no-eval", "--only", "no-debug-symbols", "--reporting-format", "emacs")
    assert code == 1 and out.splitlines() == ["src/a.php:4:1:note - var_dump is for debugging.", "src/a.php:3:6:error - Code is not made from text."]
    assert run("lint", "src", *here, "--only", "no-debug-symbols", "--minimum-report-level", "help")[0] == 0
    assert run("lint", "src", *here, "--only", "no-eval", "--reporting-format", "emacs", "--output", str(tmp_path / "out")) == (1, "")
    assert spark.read.text((tmp_path / "out").as_uri()).first()[0] == "src/a.php:3:6:error - Code is not made from text."
    code, out = run("check", "src", *here, "--reporting-format", "json")
    assert code == 1 and json.loads(out)["issues"][0]["line"] == 2
    code, out = run("analyze", "src", *here, "--reporting-format", "short")
    assert code == 1 and "non-existent-class-like" in out
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib/gone.php").write_text("<?php\nclass Gone extends Unknown {}\n")
    assert "non-existent-class-like" not in run("analyze", "src", *here, "--include", "lib", "--reporting-format", "short")[1]
    for loose in ((), ("--loose",)):
        base = str(tmp_path / f"base{len(loose)}.toml")
        assert run("lint", "src", *here, "--baseline", base, "--generate-baseline", *loose)[0] == 0
        assert run("lint", "src", *here, "--baseline", base, "--remove-outdated-baseline-entries", "--reporting-format", "count") == (0, "\n")
        assert "no-eval 1 src/a.php 1" in run("inspect-baseline", "--baseline", base)[1]
    assert json.loads(run("cst", str(tmp_path / "src/a.php"))[1])[0]["kind"] == "program"
    assert json.loads(run("cst", str(tmp_path / "src/a.php"), "--tokens")[1])[0]["kind"] == "open"
    assert len(json.loads(run("list-rules", "--json")[1])) > 180


def test_lines_are_those_of_the_bytes(spark, tmp_path, capsys):
    (tmp_path / "a.php").write_bytes("<?php\n// éééééééééé\n// ü\neval('1');\n".encode() + b"// \xff\n")
    assert main(["lint", "--workspace", str(tmp_path), "--only", "no-eval", "--reporting-format", "emacs"], spark) == 1
    assert capsys.readouterr().out.splitlines() == ["a.php:4:1:error - Code is not made from text."]


def test_pragmas_are_heeded(spark, tmp_path, capsys):
    (tmp_path / "a.php").write_text("<?php\ndeclare(strict_types=1);\n// é\n// @tool-ignore lint:no-eval\neval('1');\neval('2');\ng(); // @tool-ignore lint:no-goto\n")
    here = ("--workspace", str(tmp_path), "--reporting-format", "emacs", "--pragmas", "tool")
    assert main(["lint", *here, "--only", "no-eval"], spark) == 1
    assert [line.split(":")[1] for line in capsys.readouterr().out.splitlines()] == ["6"]
    main(["lint", *here, "--retain-code", "unused-pragma"], spark)
    assert [line.split(":")[1] for line in capsys.readouterr().out.splitlines()] == ["7"]


def test_guard(spark, tmp_path, capsys):
    (tmp_path / "a.php").write_text("<?php\nnamespace App\\Ui;\nuse App\\Db\\Row;\nclass Page {\n  function f() { new Row(); new \\App\\Core\\Item(); }\n}\n")
    config = tmp_path / "guard.json"
    config.write_text(json.dumps({"rules": [{"namespace": "App\\Ui", "permit": ["@self", "App\\Core"]}], "shapes": [{"on": "App\\Ui\\**", "kinds": ["class"], "must_be_final": True}]}))
    assert main(["guard", "--workspace", str(tmp_path), "--config", str(config), "--reporting-format", "emacs"], spark) == 1
    got = sorted(line.split(":", 2)[1:] for line in capsys.readouterr().out.splitlines())
    assert [line for line, _ in got] == ["4", "5"] and "must_be_final" in got[0][1] and "App\\Db\\Row" in got[1][1]
