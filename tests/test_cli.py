"""The command line from a dump to answers."""

import random

from simsift.__main__ import main


def test_commands(spark, tmp_path, capsys):
    rng = random.Random(1)
    vocabulary = "apple pear python numpy matrix story game time zone vim emacs regex string connection table user".split()
    rows = "".join(f'<row Id="{i}" PostTypeId="{2 if i % 5 == 4 else 1}" Title="{" ".join(rng.sample(vocabulary, 5))}" Body="b"/>\n' for i in range(40))
    dump = tmp_path / "posts.xml"
    dump.write_text(f"<posts>\n{rows}</posts>")
    dump, out = f"file://{dump}", f"file://{tmp_path}"
    main(["index", dump, f"{out}/index", "--range", "1", "0"])
    title = rows.split('Title="')[1].split('"')[0]
    main(["search", f"{out}/index", title])
    assert "|0 " in capsys.readouterr().out
    main(["compare", dump, "--hashes", "sha1"])
    assert "sha1" in capsys.readouterr().out
    main(["train", dump, f"{out}/model", "--model", "fcn", "--epochs", "1", "--range", "1", "8"])
    main(["encode", dump, f"{out}/model", f"{out}/codes"])
    main(["lookup", f"{out}/codes", f"{out}/model", title])
    assert "query" in capsys.readouterr().out
