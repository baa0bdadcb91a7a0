from larkspur.sources import files


def test_folders(spark, tmp_path):
    for name, text in {"a.md": "one", "b/c.md": "two\nlines", "b/blank.md": " \n", "dist/d.md": "no", ".hid/e.md": "no", "f.txt": "no"}.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    rows = files.documents(spark, str(tmp_path / "root")).collect()
    assert {(r.path, r.body, r.bytes) for r in rows} == {("a.md", "one", 3), ("b/c.md", "two\nlines", 9)}
    assert all(r.modified_at for r in rows)


def test_conversation_exports(spark):
    import json

    from larkspur.sources import formats

    say = "something long enough"
    tree = {"mapping": {"a": {"message": None}, "b": {"message": {"author": {"role": "assistant"}, "content": {"parts": [say, "more"]}}}, "c": {"message": {"author": {"role": "tool"}, "content": {"parts": ["ten chars."]}}}}}
    chat = {"uuid": "u", "chat_messages": [{"sender": "human", "text": say}, {"sender": "assistant", "text": "short"}, {"sender": "assistant", "text": say}]}
    files = {
        "trees": json.dumps([tree, tree]),
        "tree": json.dumps(tree),
        "chats": json.dumps([chat]),
        "chat": json.dumps(chat),
        "messages": json.dumps([{"role": "system", "content": say}, {"role": "assistant", "content": say}]),
        "lines": "\n".join([json.dumps({"role": "assistant", "message": say}), "noise", "{broken", json.dumps({"text": say})]),
        "plain": "First paragraph of the text.\n\nshort\n\n\nSecond paragraph of the text.",
        "other": json.dumps({"a": "twenty characters and more"}),
        "empty": "",
    }
    rows = formats.conversations(spark.createDataFrame(list(files.items()), "file string, raw string")).collect()
    got = {f: [(r.role, r.text) for r in sorted(rows, key=lambda r: r.turn) if r.file == f] for f in files}
    user, assistant = ("user", say), ("assistant", say)
    told = ("assistant", say + "\nmore")
    assert got["trees"] == [told, told] and got["tree"] == [told]
    assert got["chats"] == got["chat"] == [user, assistant]
    assert got["messages"] == [user, assistant] and got["lines"] == [assistant, user]
    assert got["plain"] == [("user", "First paragraph of the text."), ("user", "Second paragraph of the text.")]
    assert got["other"] == [("user", files["other"])] and got["empty"] == []
