"""A small project of our own, in nine languages, with its manifests, logs and patches: what the tables at hand lack.

Operators on code read the relation ``code``; over the tables it holds these lines beside those of the documents, over a
source tree the tree's own.
"""

from __future__ import annotations

FILES = {
    "shop/app.js": """const { open, read: load } = require('./store')
import fs from 'fs'
import path from 'path'
// import old from './old'
export function run(cmd, name) {
  eval(cmd)
  exec(cmd + name)
  re.exec(name)
  child_process.exec(`rm ${name}`)
  spawn('sh', { shell: true })
  el.innerHTML = load(name)
  console.log("token", name)
  if (token === name) process.exit(1)
  return path.join(fs.readFileSync(name), './x')
}
const LIMIT = 10
let total = JSON.parse("{}")
const dynamic = process.env.API_URL
import('./lazy')
// TODO(ann): fix it
/* FIXME broken */
// lint-ignore eval
eval(total) // lint-ignore eval
fetch("http://billing:8080/x")
""",
    "shop/store.js": """import { run } from './app'
function open(a, b) { return a }
const read = (k) => open(k)
class Box extends Base {
  put(k) {
    return read(k)
  }
}
module.exports = { open, read }
throw new AppError('z')
throw new TypeError(y)
createHash("md5")
q = "select * from t where a=" + x
q = "select * from t where a=? and b=" + x
db_url = "x"; api_key: "abcdefghijklmnopqrst"
app.get('/login', h)
""",
    "shop/lazy.js": "import './store'\nexport const lazy = 1\n",
    "shop/lib/app.js": "import '../store'\nexport default 1\n",
    "shop/main.py": '''import os
import sys as system
from shop.store import load, save as keep
import numpy as np
import yaml
LIMIT: int = 3
class Runner:
    """Runs things."""
    @cached
    def run(self, x):
        # a comment
        """Runs x."""
        if not x:
            raise ValueError("no")
        try:
            return load(f"{x} {self.n!r:>{width}}")
        except:
            raise CustomError(
                x)
def main():
    r = Runner()
    r.run(os.environ["DB_HOST"])
    os.getenv("CI")
    cursor.execute("SELECT * FROM users WHERE id = 1")
    cursor.execute("INSERT INTO orders VALUES (1)")
    missing(np)
    password = "hunter22"
''',
    "shop/test_main.py": '''from unittest.mock import Mock
def test_login():
    m = Mock()
    m.load.return_value = "text"
    m.keep(1)
def test_run():
    pass
def helper():
    pass
''',
    "shop/store.py": '''def load(a: int, b: int) -> int:
    return a
def save(x) -> str:
    return "x"
''',
    "shop/worker.go": """package main
import "fmt"
func (t *Thing) Go() error {
	x := helper(t.n)
	fmt.Sprint(x)
	return nil
}
func TestParse(t *testing.T) {}
""",
    "shop/pool.rs": """use std::fs;
pub fn start() {
    let x = y.unwrap();
    panic!("no");
}
#[cfg(test)]
mod tests {
    fn t() { z.unwrap(); }
}
""",
    "shop/.env": "API_URL=http://x\n# c\nDB_PASSWORD=verysecret99\n",
    "shop/docker-compose.yml": "version: '3'\nservices:\n  web:\n    image: a\n  billing:\n    image: b\nvolumes:\n  data:\n",
    "shop/package.json": '{\n  "name": "shop",\n  "dependencies": {\n    "left-pad": "^1.3.0",\n    "lodash": "4.x"\n  },\n  "devDependencies": {\n    "jest": "^29.0.0"\n  }\n}\n',
    "shop/package-lock.json": '{\n  "packages": {\n    "node_modules/left-pad": {\n      "version": "1.3.1"\n    },\n    "node_modules/jest": {\n      "version": "29.7.0"\n    }\n  }\n}\n',
    "shop/requirements.txt": "# note\nflask==2.0\nnumpy>=1.2,<2\npyyaml\n-r other.txt\n",
    "shop/pyproject.toml": '[project]\nname = "shop"\ndependencies = [\n  "requests>=2.1",\n  "click",\n]\n[tool.poetry.dependencies]\npython = "^3.9"\nhttpx = "^0.27"\n[tool.other]\nx = "1"\n',
    "shop/poetry.lock": '[[package]]\nname = "requests"\nversion = "2.31.0"\n[[package]]\nname = "httpx"\nversion = "0.27.2"\n',
    "shop/go.mod": "module me\ngo 1.22\nrequire example.org/x v1.2.3\nrequire (\n\texample.org/y v0.4.0\n)\n",
    "shop/go.sum": "example.org/x v1.2.3 h1:aaa=\nexample.org/x v1.2.3/go.mod h1:bbb=\nexample.org/y v0.4.0 h1:ccc=\n",
    "shop/Cargo.toml": '[package]\nname = "me"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.38", features = ["full"] }\n[dev-dependencies]\nrand = "0.8"\n[profile.release]\nlto = "fat"\n',
    "shop/Cargo.lock": '[[package]]\nname = "serde"\nversion = "1.0.203"\n[[package]]\nname = "tokio"\nversion = "1.38.0"\n',
    "shop/logs/pytest.log": "\x1b[1mtest_main.py::test_login PASSED\x1b[0m\ntest_main.py::test_run FAILED\ntest_main.py::test_skip SKIPPED\n=== 1 failed, 1 passed, 1 skipped in 0.12s ===\n",
    "shop/logs/go.log": "=== RUN   TestParse\n--- PASS: TestParse (0.00s)\n--- FAIL: TestWrite (0.01s)\n--- SKIP: TestSlow (0.00s)\nFAIL\n",
    "shop/logs/jest.log": "Tests:       2 failed, 1 skipped, 7 passed, 10 total\n",
    "shop/logs/trace.log": """TypeError: x is not a function
    at run (shop/app.js:12:5)
    at Object.<anonymous> (shop/store.js:3:1)
Traceback (most recent call last):
  File "shop/main.py", line 14, in run
KeyError: 'k'
panic: runtime error: index out of range
	shop/worker.go:4 +0x1d
thread 'main' panicked at shop/pool.rs:3:9:
ECONNREFUSED 127.0.0.1:5432
""",
    "shop/logs/tsc.log": "shop/a.ts(3,5): error TS2304: Cannot find name 'x'.\nshop/b.ts(1,1): warning TS6133: 'y' is declared but never used.\nFound 2 errors.\n",
    "shop/logs/eslint.log": "shop/app.js:12:5: 'cmd' is not defined [Error/no-undef]\nshop/app.js:20:1: Missing semicolon [Warning/semi]\n",
    "shop/change.patch": """<<<<<<< SEARCH
old text
=======
new text
>>>>>>> REPLACE
<<<<<<< SEARCH
never closed
""",
    "shop/change.diff": """--- a/shop/app.js
+++ b/shop/app.js
@@ -1,2 +1,3 @@
 same
-gone
+added one
+added two
--- a/shop/new.py
+++ b/shop/new.py
@@ -0,0 +1 @@
+print(1)
""",
    "shop/odd.txt": "f(a[b]{c})\nf(a]\n",
}

ROWS = [(path, i, line) for path, text in sorted(FILES.items()) for i, line in enumerate(text.rstrip("\n").split("\n"), 1)]
