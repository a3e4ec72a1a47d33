"""Command lines and what they read and write."""

import pytest
from pyspark.sql import functions as F

from wakeline.operators import extraction, shell

HOME = "/home/al/work"
CASES = {
    # Redirects: output of a command, with or without its errors, but neither errors alone nor devices.
    "date >> days.txt 2>>/tmp/bad": [f"write file {HOME}/days.txt"],
    "run &> both.txt; run >| /x; run 2>&1 >/dev/stderr": [f"write file {HOME}/both.txt", "write file /x"],
    "sort < names > $HOME/sorted": ["write file ~/sorted"],
    "say 'a > b' \"c > d\" e\\>f": [],
    # Readers, whose output is shown.
    "tac one 'two three' | bat": [f"read file {HOME}/one", f"read file {HOME}/two three"],
    "tail -n 3 -- -z ~/y": [f"read file {HOME}/-z", "read file ~/y"],
    "head -c9 < ./q/../in": [f"read file {HOME}/in"],
    "cat one one ./one > two": [f"write file {HOME}/two"],
    "cat ${X}.txt a?b $(which ls) `ls`": [],
    "sed -n '2p;$p' book; sed -n /x/p book; sed 2d book": [f"read file {HOME}/book"],
    "yes | tee -a p q >/dev/null": [f"write file {HOME}/p", f"write file {HOME}/q"],
    # Here-documents and comments are text.
    "tee k <<-'END' # cat j\n\tcat i\n\tEND\ncat l": [f"write file {HOME}/k", f"read file {HOME}/l"],
    # Folders.
    "cd; cat f; cd /v/w; cat ../f; cd -; cat f": ["read file ~/f", "read file /v/f"],
    "cd ${SOME}; cat f": ["read file f"],
    "(cd /v; (cd w; cat f)); cat f": ["read file /v/w/f", f"read file {HOME}/f"],
    'sh -c "cd /v; cat f" && cat g': ["read file /v/f", f"read file {HOME}/g"],
    # Wrappers and assignments.
    "A=b nice -n 5 sudo -u me env C=d timeout 3s /bin/cat f": [f"read file {HOME}/f"],
    # Requests.
    "curl -sSL site.org/a?b=c | wc": ["read url http://site.org/a?b=c"],
    "curl -so f https://s/a; curl -LO https://s/b; wget https://s/c": [f"write file {HOME}/f"],
    "curl -d @f https://s/a -o -; curl -G -d x=y https://s/b; curl -I https://s/c": ["write url https://s/a", "read url https://s/b", "read url https://s/c"],
    "curl -XPATCH https://s/a > f; curl -X OPTIONS https://s/b": ["write url https://s/a", f"write file {HOME}/f"],
    "wget -O - https://s/a; wget --method=DELETE https://s/b; wget -Of https://s/c": ["read url https://s/a", "write url https://s/b", f"write file {HOME}/f"],
    # Repositories: only of clones and remotes that are known.
    "git push; git pull origin": [],
    "git clone ssh://git@H.com/A/B.git && cd B && git fetch && git push -u origin main": ["read repository h.com/a/b", "write repository h.com/a/b"],
    "git remote add up git@h.com:x/y; git push --dry-run up; cd sub; git pull up": ["read repository h.com/x/y"],
    "git clone https://h.com/a/b c; git -C c show v1:d/e; cd c/d; git show v1:./e > f": ["read repository h.com/a/b", "read file h.com/a/b/d/e", f"write file {HOME}/c/d/f"],
    "gh pr list; glab mr view 5": [],
    "gh repo clone A/b; cd b; gh pr create --title t; gh pr view 5; gh issue edit '#6'": [
        "read repository github.com/a/b", "write url https://github.com/a/b/pulls", "read url https://github.com/a/b/issues/5", "write url https://github.com/a/b/issues/6"],
    "glab mr update 8 -R g/s/p; glab issue view https://gitlab.com/g/q/-/issues/4": [
        "write url https://gitlab.com/g/s/p/-/merge_requests/8", "read url https://gitlab.com/g/q/-/issues/4"],
    "gh api -X DELETE /a/b; gh api graphql -f q=1; glab api projects -F n=1; gh api c --hostname h.org": [
        "write url https://api.github.com/a/b", "write url https://gitlab.com/api/v4/projects", "read url https://h.org/api/v3/c"],
    # Unfinished or empty lines do nothing.
    "cat f; say 'x": [], "cat f >": [], "cat f; say $(x": [], "": [], " ; && )": [],
}


@pytest.mark.parametrize("line", CASES)
def test_line(line):
    assert [" ".join(a) for a in shell.accesses(line, shell.Shell(cwd=HOME))] == CASES[line]


def test_conversation_keeps_its_shell(spark):
    """Folders and clones go on within a conversation, in its order, and not into another."""
    lines = [("a", 3, "cat f; git push"), ("a", 1, "cd /srv/x"), ("a", 2, "git clone https://h.com/o/r . "), ("b", 9, "cat f; git push"), ("a", 4, None)]
    calls = spark.createDataFrame([(c, n, line) for c, n, line in lines], "conversation string, at long, argument string")
    found = calls.withColumns({"call": F.concat("conversation", "at"), "family": F.lit("shell")})
    got = extraction.shell_accesses(found, ["conversation"], "at").collect()
    assert {(r["call"], r["op"], r["target"]) for r in got} == {
        ("a2", "read", "h.com/o/r"), ("a3", "read", "/srv/x/f"), ("a3", "write", "h.com/o/r"), ("b9", "read", "f")
    }
