"""The rows that queries over the invented project are expected to give.

They were taken from the operators' results once and read against the files, row by row: they hold what
was right then, and are no second way to the same rows. For each query: its columns with DuckDB's types, and the rows.
"""

# fmt: off
EXPECTED = {
    'code_facts': (
        'path VARCHAR, fact VARCHAR, name VARCHAR, detail VARCHAR, line BIGINT, value BIGINT',
        [
            ('app/flow.py', 'call', 'cur.execute', '', 10, 2),
            ('app/flow.py', 'call', 'cur.execute', '', 11, 1),
            ('app/flow.py', 'call', 'int', '', 7, 1),
            ('app/flow.py', 'call', 'open', '', 8, 1),
            ('app/flow.py', 'call', 'open', '', 9, 1),
            ('app/flow.py', 'call', 'request.args.get', '', 5, 1),
            ('app/flow.py', 'call', 'request.args.get', '', 7, 1),
            ('app/flow.py', 'complexity', 'report', '', 4, 1),
            ('app/flow.py', 'function', 'report', '', 4, 8),
            ('app/flow.py', 'import', 'flask', '', 1, 0),
            ('app/flow.py', 'import', 'flask.request', '', 1, 0),
            ('app/flow.py', 'parameters', 'report', '', 4, 0),
            ('app/main.py', 'base', 'Base', 'Page', 21, 0),
            ('app/main.py', 'call', 'app.route', '', 9, 1),
            ('app/main.py', 'call', 'os.path.join', '', 18, 2),
            ('app/main.py', 'call', 'request.args.get', '', 11, 1),
            ('app/main.py', 'call', 'self.render', '', 23, 0),
            ('app/main.py', 'call', 'store.lookup', '', 13, 2),
            ('app/main.py', 'call', 'tidy', '', 14, 1),
            ('app/main.py', 'class', 'Page', '', 21, 3),
            ('app/main.py', 'complexity', '_unused', '', 17, 1),
            ('app/main.py', 'complexity', 'serve', '', 10, 3),
            ('app/main.py', 'complexity', 'show', 'Page', 22, 1),
            ('app/main.py', 'export', 'serve', '', 6, 0),
            ('app/main.py', 'function', '_unused', '', 17, 2),
            ('app/main.py', 'function', 'serve', '', 10, 5),
            ('app/main.py', 'function', 'show', 'Page', 22, 2),
            ('app/main.py', 'import', 'app.util', '', 3, 0),
            ('app/main.py', 'import', 'app.util.clean', '', 3, 0),
            ('app/main.py', 'import', 'db.store', '', 2, 0),
            ('app/main.py', 'import', 'flask', '', 4, 0),
            ('app/main.py', 'import', 'flask.request', '', 4, 0),
            ('app/main.py', 'import', 'os', '', 1, 0),
            ('app/main.py', 'parameters', '_unused', 'a,b', 17, 2),
            ('app/main.py', 'parameters', 'serve', 'name,rest,mode', 10, 2),
            ('app/main.py', 'parameters', 'show', 'self', 22, 1),
            ('app/main.py', 'registered', 'serve', 'app.route', 10, 0),
            ('app/util.py', 'call', 'clean', '', 13, 1),
            ('app/util.py', 'call', 'text.strip', '', 9, 0),
            ('app/util.py', 'complexity', 'clean', '', 4, 1),
            ('app/util.py', 'complexity', 'main', '', 12, 1),
            ('app/util.py', 'function', 'clean', '', 4, 6),
            ('app/util.py', 'function', 'main', '', 12, 2),
            ('app/util.py', 'import', 'app.main', '', 1, 0),
            ('app/util.py', 'parameters', 'clean', 'text', 4, 1),
            ('app/util.py', 'parameters', 'main', '', 12, 0),
            ('db/store.py', 'call', 'cur.execute', '', 7, 1),
            ('db/store.py', 'call', 'other', '', 8, 1),
            ('db/store.py', 'call', 'sqlite3.connect', '', 6, 1),
            ('db/store.py', 'complexity', 'lookup', '', 5, 1),
            ('db/store.py', 'complexity', 'other', '', 11, 1),
            ('db/store.py', 'function', 'lookup', '', 5, 4),
            ('db/store.py', 'function', 'other', '', 11, 2),
            ('db/store.py', 'import', 'app', '', 2, 0),
            ('db/store.py', 'import', 'app.util', '', 2, 0),
            ('db/store.py', 'import', 'sqlite3', '', 1, 0),
            ('db/store.py', 'parameters', 'lookup', 'sql,mode', 5, 2),
            ('db/store.py', 'parameters', 'other', 'mode', 11, 1),
            ('src/K.kt', 'base', 'Base', 'K', 2, 0),
            ('src/K.kt', 'base', 'Face', 'K', 2, 0),
            ('src/K.kt', 'call', 'call', '', 3, 0),
            ('src/K.kt', 'class', 'K', '', 2, 3),
            ('src/K.kt', 'complexity', 'go', '', 3, 1),
            ('src/K.kt', 'function', 'go', '', 3, 1),
            ('src/K.kt', 'import', 'a.b.C', '', 1, 0),
            ('src/K.kt', 'parameters', 'go', 'a', 3, 1),
            ('src/M.java', 'base', 'N', 'M', 2, 0),
            ('src/M.java', 'base', 'P', 'M', 2, 0),
            ('src/M.java', 'base', 'Q', 'M', 2, 0),
            ('src/M.java', 'call', 'Runtime.getRuntime', '', 5, 0),
            ('src/M.java', 'call', 'exec', '', 5, 0),
            ('src/M.java', 'call', 'g', '', 4, 0),
            ('src/M.java', 'call', 'run', '', 4, 0),
            ('src/M.java', 'class', 'M', '', 2, 5),
            ('src/M.java', 'complexity', 'M', '', 3, 1),
            ('src/M.java', 'complexity', 'f', '', 4, 3),
            ('src/M.java', 'complexity', 'x', '', 5, 1),
            ('src/M.java', 'function', 'M', '', 3, 1),
            ('src/M.java', 'function', 'f', '', 4, 1),
            ('src/M.java', 'function', 'x', '', 5, 1),
            ('src/M.java', 'import', 'java.util.List', '', 1, 0),
            ('src/M.java', 'new', 'H', '', 4, 0),
            ('src/M.java', 'parameters', 'M', 'a', 3, 1),
            ('src/M.java', 'parameters', 'f', 'a,b', 4, 2),
            ('src/M.java', 'parameters', 'x', '', 5, 0),
            ('src/x.go', 'base', 'Base', 'A', 7, 0),
            ('src/x.go', 'call', 'fmt.Println', '', 10, 0),
            ('src/x.go', 'class', 'A', '', 6, 4),
            ('src/x.go', 'complexity', 'Run', '', 10, 1),
            ('src/x.go', 'function', 'Run', '', 10, 1),
            ('src/x.go', 'import', 'fmt', '', 3, 0),
            ('src/x.go', 'import', 'host', '', 4, 0),
            ('src/x.go', 'parameters', 'Run', 'n', 10, 1),
            ('src/y.rs', 'base', 'Area', 'Shape', 2, 0),
            ('src/y.rs', 'call', 'helper', '', 3, 0),
            ('src/y.rs', 'call', 'step', '', 3, 0),
            ('src/y.rs', 'class', 'Shape', '', 2, 1),
            ('src/y.rs', 'complexity', 'area', '', 2, 1),
            ('src/y.rs', 'complexity', 'run', '', 3, 1),
            ('src/y.rs', 'function', 'area', '', 2, 1),
            ('src/y.rs', 'function', 'run', '', 3, 1),
            ('src/y.rs', 'import', 'std::fmt', '', 1, 0),
            ('src/y.rs', 'parameters', 'area', 'self', 2, 1),
            ('src/y.rs', 'parameters', 'run', 'a', 3, 1),
            ('src/z.cpp', 'base', 'B1', 'D', 3, 0),
            ('src/z.cpp', 'base', 'ns::B2', 'D', 3, 0),
            ('src/z.cpp', 'call', 'go', '', 4, 0),
            ('src/z.cpp', 'call', 'strcpy', '', 4, 0),
            ('src/z.cpp', 'call', 'used', '', 4, 0),
            ('src/z.cpp', 'class', 'D', '', 3, 1),
            ('src/z.cpp', 'complexity', 'D', '', 3, 1),
            ('src/z.cpp', 'complexity', 'bar', '', 4, 1),
            ('src/z.cpp', 'complexity', 'z', '', 5, 2),
            ('src/z.cpp', 'function', 'D', '', 3, 1),
            ('src/z.cpp', 'function', 'bar', '', 4, 1),
            ('src/z.cpp', 'function', 'z', '', 5, 1),
            ('src/z.cpp', 'import', 'stdio.h', '', 1, 0),
            ('src/z.cpp', 'parameters', 'D', '', 3, 0),
            ('src/z.cpp', 'parameters', 'bar', 's', 4, 1),
            ('src/z.cpp', 'parameters', 'z', '', 5, 0),
            ('tests/test_main.py', 'complexity', 'helper_only', '', 4, 1),
            ('tests/test_main.py', 'function', 'helper_only', '', 4, 2),
            ('tests/test_main.py', 'import', 'app.main', '', 1, 0),
            ('tests/test_main.py', 'parameters', 'helper_only', '', 4, 0),
            ('tools/risky.py', 'call', 'eval', '', 6, 1),
            ('tools/risky.py', 'call', 'hashlib.md5', '', 5, 1),
            ('tools/risky.py', 'call', 'password.encode', '', 5, 0),
            ('tools/risky.py', 'call', 'pickle.loads', '', 3, 1),
            ('tools/risky.py', 'call', 'subprocess.run', '', 4, 1),
            ('tools/risky.py', 'import', 'hashlib', '', 1, 0),
            ('tools/risky.py', 'import', 'pickle', '', 1, 0),
            ('tools/risky.py', 'import', 'subprocess', '', 1, 0),
            ('tools/slow.py', 'base', 'Shape', 'Square', 28, 0),
            ('tools/slow.py', 'base', 'abc.ABC', 'Shape', 22, 0),
            ('tools/slow.py', 'call', 'db.execute', '', 11, 1),
            ('tools/slow.py', 'call', 'fib', '', 19, 1),
            ('tools/slow.py', 'call', 'fib', '', 19, 1),
            ('tools/slow.py', 'call', 'len', '', 13, 1),
            ('tools/slow.py', 'call', 'open', '', 12, 1),
            ('tools/slow.py', 'call', 're.compile', '', 9, 1),
            ('tools/slow.py', 'class', 'Shape', '', 22, 4),
            ('tools/slow.py', 'class', 'Square', '', 28, 2),
            ('tools/slow.py', 'complexity', 'area', 'Shape', 24, 1),
            ('tools/slow.py', 'complexity', 'fib', '', 16, 2),
            ('tools/slow.py', 'complexity', 'scan', '', 4, 4),
            ('tools/slow.py', 'function', 'area', 'Shape', 24, 2),
            ('tools/slow.py', 'function', 'fib', '', 16, 4),
            ('tools/slow.py', 'function', 'scan', '', 4, 10),
            ('tools/slow.py', 'import', 'abc', '', 1, 0),
            ('tools/slow.py', 'import', 're', '', 1, 0),
            ('tools/slow.py', 'mutable-default', 'scan', '', 4, 0),
            ('tools/slow.py', 'parameters', 'area', 'self', 24, 1),
            ('tools/slow.py', 'parameters', 'fib', 'n', 16, 1),
            ('tools/slow.py', 'parameters', 'scan', 'rows,total,kept', 4, 3),
            ('web/app.js', 'base', 'Base', 'View', 4, 0),
            ('web/app.js', 'call', 'go', '', 3, 0),
            ('web/app.js', 'call', 'paint', '', 3, 0),
            ('web/app.js', 'class', 'View', '', 4, 1),
            ('web/app.js', 'complexity', 'add', '', 5, 1),
            ('web/app.js', 'complexity', 'draw', '', 3, 2),
            ('web/app.js', 'complexity', 'paint', '', 4, 3),
            ('web/app.js', 'function', 'add', '', 5, 1),
            ('web/app.js', 'function', 'draw', '', 3, 1),
            ('web/app.js', 'function', 'paint', '', 4, 1),
            ('web/app.js', 'import', './lib', '', 1, 0),
            ('web/app.js', 'parameters', 'add', 'a,b', 5, 2),
            ('web/app.js', 'parameters', 'draw', 'a,b', 3, 2),
            ('web/app.js', 'parameters', 'paint', 'x', 4, 1),
            ('web/lib.js', 'call', 'go', '', 2, 0),
            ('web/lib.js', 'call', 'paint', '', 2, 0),
            ('web/lib.js', 'complexity', 'draw', '', 2, 2),
            ('web/lib.js', 'complexity', 'go', '', 1, 1),
            ('web/lib.js', 'function', 'draw', '', 2, 1),
            ('web/lib.js', 'function', 'go', '', 1, 1),
            ('web/lib.js', 'parameters', 'draw', 'a,b', 2, 2),
            ('web/lib.js', 'parameters', 'go', 'x', 1, 1),
        ],
    ),
    'code_aliases': (
        'path VARCHAR, name VARCHAR, detail VARCHAR',
        [
            ('app/flow.py', 'request', 'flask.request'),
            ('app/main.py', 'os', 'os'),
            ('app/main.py', 'request', 'flask.request'),
            ('app/main.py', 'store', 'db.store'),
            ('app/main.py', 'tidy', 'app.util.clean'),
            ('app/util.py', 'app', 'app'),
            ('db/store.py', 'sqlite3', 'sqlite3'),
            ('db/store.py', 'util', 'app.util'),
            ('tests/test_main.py', 'app', 'app'),
            ('tools/risky.py', 'hashlib', 'hashlib'),
            ('tools/risky.py', 'pickle', 'pickle'),
            ('tools/risky.py', 'subprocess', 'subprocess'),
            ('tools/slow.py', 'abc', 'abc'),
            ('tools/slow.py', 're', 're'),
        ],
    ),
    'code_symbols': (
        'path VARCHAR, symbols VARCHAR',
        [
            ('app/flow.py', 'report'),
            ('app/main.py', 'Page,_unused,serve,show'),
            ('app/util.py', 'clean,main'),
            ('db/store.py', 'lookup,other'),
            ('src/K.kt', 'K,go'),
            ('src/M.java', 'M,f,x'),
            ('src/x.go', 'A,Run'),
            ('src/y.rs', 'Shape,area,run'),
            ('src/z.cpp', 'D,bar,z'),
            ('tests/test_main.py', 'helper_only'),
            ('tools/slow.py', 'Shape,Square,area,fib,scan'),
            ('web/app.js', 'View,add,draw,paint'),
            ('web/lib.js', 'draw,go'),
        ],
    ),
    'code_parameters': (
        'path VARCHAR, name VARCHAR, place INTEGER, parameter VARCHAR',
        [
            ('app/main.py', '_unused', 0, 'a'),
            ('app/main.py', '_unused', 1, 'b'),
            ('app/main.py', 'serve', 0, 'name'),
            ('app/main.py', 'serve', 1, 'rest'),
            ('app/main.py', 'serve', 2, 'mode'),
            ('app/main.py', 'show', 0, 'self'),
            ('app/util.py', 'clean', 0, 'text'),
            ('src/K.kt', 'go', 0, 'a'),
            ('src/M.java', 'M', 0, 'a'),
            ('src/M.java', 'f', 0, 'a'),
            ('src/M.java', 'f', 1, 'b'),
            ('src/x.go', 'Run', 0, 'n'),
            ('src/y.rs', 'area', 0, 'self'),
            ('src/y.rs', 'run', 0, 'a'),
            ('src/z.cpp', 'bar', 0, 's'),
        ],
    ),
    'code_dependencies': (
        'path VARCHAR, module VARCHAR, origin VARCHAR',
        [
            ('app/flow.py', 'flask', 'third_party'),
            ('app/main.py', 'app', 'local'),
            ('app/main.py', 'db', 'local'),
            ('app/main.py', 'flask', 'third_party'),
            ('app/main.py', 'os', 'standard'),
            ('app/util.py', 'app', 'local'),
            ('db/store.py', 'app', 'local'),
            ('db/store.py', 'sqlite3', 'standard'),
            ('tests/test_main.py', 'app', 'local'),
            ('tools/risky.py', 'hashlib', 'standard'),
            ('tools/risky.py', 'pickle', 'standard'),
            ('tools/risky.py', 'subprocess', 'standard'),
            ('tools/slow.py', 'abc', 'standard'),
            ('tools/slow.py', 're', 'standard'),
        ],
    ),
    'code_references': (
        'path VARCHAR, target VARCHAR',
        [
            ('app/main.py', 'app.main'),
            ('app/util.py', 'app.main'),
            ('db/store.py', 'app.main'),
            ('src/K.kt', 'go'),
            ('src/z.cpp', 'go'),
            ('tests/test_main.py', 'app.main'),
            ('web/app.js', 'go'),
            ('web/lib.js', 'go'),
        ],
    ),
    'code_rules': (
        'file VARCHAR, line INTEGER, type VARCHAR, severity VARCHAR',
        [
            ('.env', 1, 'key-leak', 'high'),
            ('app/flow.py', 11, 'sql-injection', 'critical'),
            ('requirements.txt', 1, 'unpinned-dependency', 'low'),
            ('src/M.java', 5, 'command-execution', 'high'),
            ('src/z.cpp', 4, 'buffer-overflow', 'high'),
            ('tools/risky.py', 2, 'hardcoded-secret', 'high'),
            ('tools/risky.py', 3, 'unsafe-deserialisation', 'critical'),
            ('tools/risky.py', 4, 'command-injection', 'critical'),
            ('tools/risky.py', 5, 'weak-hash', 'medium'),
            ('tools/risky.py', 6, 'dynamic-exec', 'critical'),
            ('web/app.js', 3, 'xss', 'high'),
            ('web/lib.js', 2, 'xss', 'high'),
        ],
    ),
    'code_file_rules': (
        'file VARCHAR, line INTEGER, type VARCHAR, severity VARCHAR',
        [
            ('app/main.py', 9, 'auth-bypass', 'high'),
        ],
    ),
    'code_scopes': (
        'scope VARCHAR, severity VARCHAR, findings BIGINT',
        [
            ('core', 'critical', 4),
            ('core', 'high', 8),
            ('core', 'low', 3),
            ('core', 'medium', 10),
        ],
    ),
    'code_suggestions': (
        'type VARCHAR, findings BIGINT, advice VARCHAR',
        [
            ('buffer-overflow', 1, 'use functions with a size'),
            ('command-execution', 1, 'check commands against an allow-list'),
            ('command-injection', 1, 'pass argument lists without a shell'),
            ('dynamic-exec', 1, 'replace evaluated text by a table of functions'),
            ('hardcoded-secret', 1, 'read secrets from the environment'),
            ('key-leak', 1, 'look at each'),
            ('sql-injection', 1, 'bind parameters'),
            ('unpinned-dependency', 1, 'look at each'),
            ('unsafe-deserialisation', 1, 'read a data format instead'),
            ('weak-hash', 1, 'use a password hash'),
            ('xss', 2, 'escape what is shown'),
        ],
    ),
    'code_detectors': (
        'path VARCHAR, family VARCHAR, line BIGINT, type VARCHAR, severity VARCHAR, name VARCHAR',
        [
            ('tools/risky.py', 'dynamic', 6, 'dynamic-code', 'high', 'eval'),
            ('tools/risky.py', 'logic', 8, 'is-literal', 'medium', ''),
            ('tools/risky.py', 'smell', 8, 'magic-number', 'low', '5'),
            ('tools/slow.py', 'contract', 28, 'abstract-method-missing', 'medium', 'area'),
            ('tools/slow.py', 'logic', 13, 'division-by-zero', 'low', 'total'),
            ('tools/slow.py', 'logic', 4, 'mutable-default', 'medium', 'scan'),
            ('tools/slow.py', 'performance', 11, 'query-in-loop', 'high', 'execute'),
            ('tools/slow.py', 'performance', 12, 'resource-leak', 'medium', 'f'),
            ('tools/slow.py', 'performance', 16, 'recursion-without-cache', 'medium', 'fib'),
            ('tools/slow.py', 'performance', 6, 'nested-loops', 'medium', ''),
            ('tools/slow.py', 'performance', 7, 'concat-in-loop', 'medium', ''),
            ('tools/slow.py', 'performance', 8, 'search-in-loop', 'medium', ''),
            ('tools/slow.py', 'performance', 9, 'compile-in-loop', 'medium', ''),
        ],
    ),
    'code_family_scores': (
        'family VARCHAR, score BIGINT, grade VARCHAR',
        [
            ('logic', 12, 'B'),
            ('performance', 42, 'C'),
        ],
    ),
    'code_smell_counts': (
        'type VARCHAR, n BIGINT',
        [
            ('magic-number', 1),
        ],
    ),
    'code_patterns': (
        'path VARCHAR, line BIGINT, rule VARCHAR, severity VARCHAR',
        [
            ('app/flow.py', 11, 'sql_injection', 'medium'),
            ('db/store.py', 7, 'sql_injection', 'medium'),
            ('tools/risky.py', 2, 'hardcoded_password', 'medium'),
            ('tools/risky.py', 3, 'insecure_pickle', 'high'),
            ('tools/risky.py', 5, 'weak_hash_md5', 'low'),
            ('tools/risky.py', 6, 'dangerous_eval', 'high'),
            ('tools/slow.py', 11, 'sql_injection', 'medium'),
        ],
    ),
    'code_pattern_search': (
        'path VARCHAR, line BIGINT, holes VARCHAR',
        [
            ('app/flow.py', 11, "M=cur,Q='select ' + name"),
            ('db/store.py', 7, 'M=cur,Q=sql'),
            ('tools/risky.py', 4, 'F=subprocess.run,X=cmd'),
            ('tools/slow.py', 11, 'M=db,Q=rows[s]'),
        ],
    ),
    'code_taint': (
        'path VARCHAR, line BIGINT, type VARCHAR, severity VARCHAR',
        [
            ('app/flow.py', 11, 'sql-injection', 'critical'),
            ('app/flow.py', 8, 'path-traversal', 'high'),
        ],
    ),
    'code_cross_taint': (
        'path VARCHAR, line BIGINT, type VARCHAR, severity VARCHAR, evidence VARCHAR',
        [
            ('db/store.py', 7, 'sql-injection', 'critical', 'app/main.py'),
        ],
    ),
    'code_dead': (
        'path VARCHAR, fact VARCHAR, name VARCHAR, line BIGINT, confidence VARCHAR',
        [
            ('app/flow.py', 'function', 'report', 4, 'medium'),
            ('app/main.py', 'class', 'Page', 21, 'medium'),
            ('app/main.py', 'function', '_unused', 17, 'high'),
            ('app/main.py', 'function', 'show', 22, 'medium'),
            ('src/K.kt', 'class', 'K', 2, 'medium'),
            ('src/M.java', 'class', 'M', 2, 'medium'),
            ('src/M.java', 'function', 'M', 3, 'medium'),
            ('src/M.java', 'function', 'f', 4, 'medium'),
            ('src/M.java', 'function', 'x', 5, 'medium'),
            ('src/x.go', 'class', 'A', 6, 'medium'),
            ('src/x.go', 'function', 'Run', 10, 'medium'),
            ('src/y.rs', 'function', 'area', 2, 'medium'),
            ('src/z.cpp', 'class', 'D', 3, 'medium'),
            ('src/z.cpp', 'function', 'D', 3, 'medium'),
            ('src/z.cpp', 'function', 'bar', 4, 'medium'),
            ('src/z.cpp', 'function', 'z', 5, 'medium'),
            ('tests/test_main.py', 'function', 'helper_only', 4, 'low'),
            ('tools/slow.py', 'class', 'Square', 28, 'medium'),
            ('tools/slow.py', 'function', 'area', 24, 'medium'),
            ('tools/slow.py', 'function', 'scan', 4, 'medium'),
            ('web/app.js', 'class', 'View', 4, 'medium'),
            ('web/app.js', 'function', 'add', 5, 'medium'),
            ('web/app.js', 'function', 'draw', 3, 'medium'),
            ('web/lib.js', 'function', 'draw', 2, 'medium'),
        ],
    ),
    'code_dead_confirmed': (
        'path VARCHAR, name VARCHAR, mentions BIGINT',
        [
            ('app/flow.py', 'report', 0),
            ('app/main.py', 'Page', 0),
            ('app/main.py', '_unused', 0),
            ('app/main.py', 'show', 0),
            ('tests/test_main.py', 'helper_only', 0),
            ('tools/slow.py', 'Square', 0),
            ('tools/slow.py', 'area', 1),
            ('tools/slow.py', 'scan', 0),
        ],
    ),
    'code_coupling': (
        'source VARCHAR, target VARCHAR, confirmed BOOLEAN',
        [
            ('app/main.py', 'db.store', True),
            ('app/main.py', 'tools.slow', False),
        ],
    ),
    'code_cycles': (
        'node VARCHAR, component VARCHAR, size BIGINT',
        [
            ('app.main', 'app.main', 3),
            ('app.util', 'app.main', 3),
            ('db.store', 'app.main', 3),
        ],
    ),
    'code_impact': (
        'path VARCHAR, depth INTEGER',
        [
            ('app/main.py', 1),
            ('app/util.py', 2),
            ('tests/test_main.py', 2),
        ],
    ),
    'code_impact_symbols': (
        'path VARCHAR, symbol VARCHAR, depth INTEGER',
        [
            ('app/main.py', 'store.lookup', 1),
        ],
    ),
    'code_call_graph': (
        'from VARCHAR, to VARCHAR, relation VARCHAR, symbol VARCHAR',
        [
            ('app/main.py', 'app/util.py', 'import', ''),
            ('app/main.py', 'db/store.py', 'call', 'store.lookup'),
            ('app/main.py', 'db/store.py', 'import', ''),
            ('app/util.py', 'app/main.py', 'import', ''),
            ('db/store.py', 'app/__init__.py', 'import', ''),
            ('db/store.py', 'app/util.py', 'import', ''),
            ('src/M.java', 'src/y.rs', 'call', 'run'),
            ('src/z.cpp', 'src/K.kt', 'call', 'go'),
            ('src/z.cpp', 'web/lib.js', 'call', 'go'),
            ('tests/test_main.py', 'app/main.py', 'import', ''),
            ('tools/risky.py', 'src/y.rs', 'call', 'subprocess.run'),
            ('web/app.js', 'src/K.kt', 'call', 'go'),
            ('web/app.js', 'web/lib.js', 'call', 'go'),
            ('web/lib.js', 'src/K.kt', 'call', 'go'),
            ('web/lib.js', 'web/app.js', 'call', 'paint'),
        ],
    ),
    'code_mermaid': (
        'text VARCHAR',
        [
            ('flowchart LR\n  n_0ee958cad886["lib.js"]\n  n_10a9d4a481a4["util.py"]\n  n_124a8b77d32c["test_main.py"]\n  n_2d690a8a1f67["M.java"]\n  n_3b5b4bf757d8["K.kt"]\n  n_49e42ceb007a["y.rs"]\n  n_60a964aea4a6["main.py"]\n  n_6b5a07a517e9["__init__.py"]\n  n_80c63d5e2487["store.py"]\n  n_d31fd61ca138["z.cpp"]\n  n_e1f8701ac457["app.js"]\n  n_ed50a6743f5a["risky.py"]\n  n_0ee958cad886 -->|call| n_3b5b4bf757d8\n  n_0ee958cad886 -->|call| n_e1f8701ac457\n  n_10a9d4a481a4 -->|import| n_60a964aea4a6\n  n_124a8b77d32c -->|import| n_60a964aea4a6\n  n_2d690a8a1f67 -->|call| n_49e42ceb007a\n  n_60a964aea4a6 -->|call| n_80c63d5e2487\n  n_60a964aea4a6 -->|import| n_10a9d4a481a4\n  n_60a964aea4a6 -->|import| n_80c63d5e2487\n  n_80c63d5e2487 -->|import| n_10a9d4a481a4\n  n_80c63d5e2487 -->|import| n_6b5a07a517e9\n  n_d31fd61ca138 -->|call| n_0ee958cad886\n  n_d31fd61ca138 -->|call| n_3b5b4bf757d8\n  n_e1f8701ac457 -->|call| n_0ee958cad886\n  n_e1f8701ac457 -->|call| n_3b5b4bf757d8\n  n_ed50a6743f5a -->|call| n_49e42ceb007a',),
        ],
    ),
    'code_core': (
        'path VARCHAR, n_in BIGINT, n_out BIGINT, hub BOOLEAN',
        [
            ('app/__init__.py', 1, 0, False),
            ('app/main.py', 2, 7, False),
            ('app/util.py', 2, 1, False),
            ('db/store.py', 1, 3, False),
            ('src/K.kt', 3, 1, False),
            ('src/y.rs', 2, 1, False),
            ('web/app.js', 1, 3, False),
            ('web/lib.js', 2, 2, False),
        ],
    ),
    'code_referring': (
        'source VARCHAR',
        [
            ('app/main.py',),
            ('db/store.py',),
        ],
    ),
    'code_module_files': (
        'module VARCHAR, path VARCHAR',
        [
            ('app', 'app/__init__.py'),
            ('app.main', 'app/main.py'),
            ('web.lib', 'web/lib.js'),
        ],
    ),
    'code_brief': (
        'path VARCHAR, class VARCHAR, size BIGINT, out VARCHAR, inn VARCHAR, symbols VARCHAR, summary VARCHAR',
        [
            ('README.md', 'weed', 40, '', '', '', 'A web server | with login over a database'),
            ('app/__init__.py', 'tree', 0, '', 'db/store.py', '', ''),
            ('app/flow.py', 'tree', 247, 'flask,flask.request', '', '', ''),
            ('app/main.py', 'tree', 411, 'app.util,app.util.clean,db.store,db/store.py,flask,flask.request,os', 'app/util.py,tests/test_main.py', '', ''),
            ('app/util.py', 'tree', 156, 'app.main', 'app/main.py,db/store.py', '', ''),
            ('db/store.py', 'tree', 180, 'app,app.util,sqlite3', 'app/main.py', '', ''),
            ('requirements.txt', 'weed', 17, '', '', '', 'flask | numpy==1.0'),
            ('src/K.kt', 'tree', 94, '', '', 'K,go', ''),
            ('src/M.java', 'tree', 244, '', '', 'M,f,x', ''),
            ('src/x.go', 'tree', 123, '', '', 'A,Run', ''),
            ('src/y.rs', 'tree', 145, '', '', 'Shape,area,run', ''),
            ('src/z.cpp', 'tree', 239, '', '', 'D,bar,z', ''),
            ('tests/test_main.py', 'tree', 50, 'app.main', '', '', ''),
            ('tools/risky.py', 'tree', 239, 'hashlib,pickle,src/y.rs,subprocess', '', '', ''),
            ('tools/slow.py', 'tree', 449, 'abc,re', '', '', ''),
            ('web/app.js', 'tree', 220, '', '', 'View,add,draw,paint', ''),
            ('web/lib.js', 'tree', 114, '', '', 'draw,go', ''),
        ],
    ),
    'code_state': (
        'total BIGINT, strong BIGINT, weak BIGINT, deep BIGINT, round INTEGER, reports INTEGER, converged BOOLEAN, active BOOLEAN',
        [
            (34, 34, 0, 9, 3, 2, True, True),
        ],
    ),
    'code_deep_scan': (
        'path VARCHAR, n_in BIGINT, n_out BIGINT, hub BOOLEAN, findings BIGINT, worst VARCHAR, top VARCHAR',
        [
            ('app/__init__.py', 1, 0, False, 0, None, ''),
            ('app/main.py', 2, 7, False, 0, None, ''),
            ('app/util.py', 2, 1, False, 0, None, ''),
            ('db/store.py', 1, 3, False, 0, None, ''),
            ('src/K.kt', 3, 1, False, 0, None, ''),
            ('src/y.rs', 2, 1, False, 0, None, ''),
            ('web/app.js', 1, 3, False, 1, 'high', 'high:xss:3'),
            ('web/lib.js', 2, 2, False, 1, 'high', 'high:xss:2'),
        ],
    ),
    'code_bridges': (
        'source VARCHAR, target VARCHAR',
        [
            ('app/main.py', 'app/util.py'),
            ('app/main.py', 'db/store.py'),
            ('app/util.py', 'app/main.py'),
            ('db/store.py', 'app/__init__.py'),
            ('db/store.py', 'app/util.py'),
            ('web/app.js', 'src/K.kt'),
            ('web/app.js', 'web/lib.js'),
            ('web/lib.js', 'src/K.kt'),
            ('web/lib.js', 'web/app.js'),
        ],
    ),
    'code_triage': (
        'source VARCHAR, target VARCHAR, state VARCHAR',
        [
            ('app/main.py', 'app.util', 'alive'),
            ('app/main.py', 'app.util.clean', 'alive'),
            ('app/main.py', 'db.store', 'alive'),
            ('app/main.py', 'db/store.py', 'alive'),
            ('app/main.py', 'flask', 'alive'),
            ('app/main.py', 'flask.request', 'alive'),
            ('app/main.py', 'os', 'alive'),
            ('app/util.py', 'app.main', 'stale'),
            ('db/store.py', 'app', 'alive'),
            ('db/store.py', 'app.util', 'alive'),
            ('db/store.py', 'sqlite3', 'alive'),
            ('src/K.kt', 'a.b.C', 'alive'),
            ('src/y.rs', 'std::fmt', 'alive'),
            ('web/app.js', './lib', 'dead'),
            ('web/app.js', 'src/K.kt', 'alive'),
            ('web/app.js', 'web/lib.js', 'dead'),
            ('web/lib.js', 'src/K.kt', 'alive'),
            ('web/lib.js', 'web/app.js', 'alive'),
        ],
    ),
    'code_project_report': (
        'files BIGINT, lines BIGINT, functions BIGINT, classes BIGINT, most_complex BIGINT, mean_complexity DOUBLE, critical BIGINT, high BIGINT, medium BIGINT, low BIGINT, hours DOUBLE, worst VARCHAR, standard VARCHAR, third_party VARCHAR, local VARCHAR',
        [
            (18, 161, 27, 9, 4, 1.48, 4, 8, 10, 3, 59.0, 'tools/slow.py,tools/risky.py,.env,app/flow.py,requirements.txt,src/M.java,src/z.cpp,web/app.js,web/lib.js', 'abc,hashlib,os,pickle,re,sqlite3,subprocess', 'flask', 'app,db'),
        ],
    ),
    'code_abilities': (
        'ability VARCHAR, files BIGINT',
        [
            ('auth', 1),
            ('database', 1),
            ('file', 1),
            ('gui', 1),
            ('network', 1),
            ('web', 2),
        ],
    ),
    'code_focus': (
        'id INTEGER, symptoms VARCHAR, focus VARCHAR',
        [
            (1, 'login,slow', 'auth-bypass,timing-attack,weak-hash,hardcoded-secret,open-redirect,query-in-loop,concat-in-loop,nested-loops,search-in-loop'),
            (2, 'no-response', 'future-not-awaited,endless-recursion'),
            (3, '', ''),
        ],
    ),
    'code_marked': (
        'file VARCHAR, line INTEGER, type VARCHAR',
        [
            ('tools/risky.py', 4, 'command-injection'),
            ('web/app.js', 3, 'xss'),
            ('web/lib.js', 2, 'xss'),
        ],
    ),
    'code_functions_alike': (
        'path_a VARCHAR, name_a VARCHAR, path_b VARCHAR, name_b VARCHAR, similarity DOUBLE',
        [
            ('web/app.js', 'draw', 'web/lib.js', 'draw', 1.0),
        ],
    ),
    'code_docstrings': (
        'file VARCHAR, line INTEGER',
        [
            ('app/util.py', 5),
            ('app/util.py', 6),
            ('app/util.py', 7),
            ('app/util.py', 8),
        ],
    ),
    'code_in_string': (
        'file VARCHAR, line INTEGER, quoted BOOLEAN',
        [
            ('tools/risky.py', 7, True),
        ],
    ),
    'code_loops': (
        'file VARCHAR, line INTEGER, until INTEGER',
        [
            ('a.js', 2, 6),
            ('a.js', 3, 5),
        ],
    ),
    'code_gate': (
        'id INTEGER, allowed BOOLEAN, reason VARCHAR, restricted BOOLEAN',
        [
            (1, True, '', False),
            (2, False, 'import socket', False),
            (2, False, 'import socket', True),
            (3, False, 'call eval', False),
            (4, False, 'attribute __class__', False),
            (5, False, 'syntax', False),
            (6, True, '', False),
            (6, True, '', True),
            (7, False, 'call open', False),
            (8, True, '', False),
        ],
    ),
    'code_levels': (
        'language VARCHAR, asked VARCHAR, level VARCHAR',
        [
            ('javascript', 'auto', 'subprocess'),
            ('python', 'auto', 'restricted'),
            ('python', 'subprocess', 'subprocess'),
        ],
    ),
    'code_inputs': (
        'path VARCHAR, name VARCHAR, inputs BIGINT, own BIGINT',
        [
            ('db/store.py', 'lookup', 31, 1),
            ('db/store.py', 'other', 30, 0),
        ],
    ),
    'code_assignments': (
        'path VARCHAR, variable VARCHAR, line BIGINT, origin VARCHAR',
        [
            ('app/main.py', '__all__', 6, 'expression'),
            ('app/main.py', 'q', 11, 'user'),
            ('tools/risky.py', 'data', 3, 'call:pickle.loads'),
            ('tools/risky.py', 'digest', 5, 'call:hashlib.md5'),
            ('tools/risky.py', 'password', 2, 'literal'),
            ('tools/risky.py', 'safe', 7, 'literal'),
            ('tools/risky.py', 'value', 6, 'call:eval'),
        ],
    ),
    'code_index': (
        'path VARCHAR, symbols VARCHAR, has_grams BOOLEAN',
        [
            ('.env', '', True),
            ('README.md', '', True),
            ('app/__init__.py', '', False),
            ('app/flow.py', 'report', True),
            ('app/main.py', 'Page,_unused,serve,show', True),
            ('app/util.py', 'clean,main', True),
            ('db/store.py', 'lookup,other', True),
            ('requirements.txt', '', True),
            ('src/K.kt', 'K,go', True),
            ('src/M.java', 'M,f,x', True),
            ('src/x.go', 'A,Run', True),
            ('src/y.rs', 'Shape,area,run', True),
            ('src/z.cpp', 'D,bar,z', True),
            ('tests/test_main.py', 'helper_only', True),
            ('tools/risky.py', '', True),
            ('tools/slow.py', 'Shape,Square,area,fib,scan', True),
            ('web/app.js', 'View,add,draw,paint', True),
            ('web/lib.js', 'draw,go', True),
        ],
    ),
    'code_files': (
        'path VARCHAR, class VARCHAR, size BIGINT, fingerprint VARCHAR',
        [
            ('.env', 'other', 29, '258d1f8257e7'),
            ('README.md', 'weed', 40, '39ab921d47f3'),
            ('app/__init__.py', 'tree', 0, 'b6589fc6ab0d'),
            ('app/flow.py', 'tree', 247, '5d9c60070599'),
            ('app/main.py', 'tree', 411, '837da4a00f2d'),
            ('app/util.py', 'tree', 156, 'c61c971f96a6'),
            ('db/store.py', 'tree', 180, 'b33b9560004a'),
            ('requirements.txt', 'weed', 17, 'efa8c1bdd3a5'),
            ('src/K.kt', 'tree', 94, '57aed78ef936'),
            ('src/M.java', 'tree', 244, '316f8c89c47d'),
            ('src/x.go', 'tree', 123, 'b14c8e759557'),
            ('src/y.rs', 'tree', 145, '41d774453ba0'),
            ('src/z.cpp', 'tree', 239, 'aa51aaa71463'),
            ('tests/test_main.py', 'tree', 50, 'c96fbe8cd727'),
            ('tools/risky.py', 'tree', 239, 'e862633ca53e'),
            ('tools/slow.py', 'tree', 449, '9c2212f8eb77'),
            ('web/app.js', 'tree', 220, '9b7b50032111'),
            ('web/lib.js', 'tree', 114, '7c6ffa1085b0'),
        ],
    ),
    'code_ignored': (
        'path VARCHAR',
        [
            ('README.md',),
            ('app/util.py',),
            ('src/x.go',),
            ('tools/risky.py',),
            ('tools/slow.py',),
        ],
    ),
    'code_bodies': (
        'path VARCHAR, name VARCHAR, first BIGINT, last BIGINT',
        [
            ('app/flow.py', 'report', 4, 11),
            ('app/main.py', '_unused', 17, 18),
            ('app/main.py', 'serve', 10, 14),
            ('app/main.py', 'show', 22, 23),
            ('app/util.py', 'clean', 4, 9),
            ('app/util.py', 'main', 12, 13),
            ('db/store.py', 'lookup', 5, 8),
            ('db/store.py', 'other', 11, 12),
            ('src/K.kt', 'go', 3, 3),
            ('src/M.java', 'M', 3, 3),
            ('src/M.java', 'f', 4, 4),
            ('src/M.java', 'x', 5, 5),
            ('src/x.go', 'Run', 10, 10),
            ('src/y.rs', 'run', 3, 3),
            ('src/z.cpp', 'D', 3, 3),
            ('src/z.cpp', 'bar', 4, 4),
            ('src/z.cpp', 'z', 5, 5),
            ('tests/test_main.py', 'helper_only', 4, 5),
            ('tools/slow.py', 'area', 24, 25),
            ('tools/slow.py', 'fib', 16, 19),
            ('tools/slow.py', 'scan', 4, 13),
            ('web/app.js', 'draw', 3, 3),
            ('web/app.js', 'paint', 4, 4),
            ('web/lib.js', 'draw', 2, 2),
            ('web/lib.js', 'go', 1, 1),
        ],
    ),
    'code_resolved_calls': (
        'source VARCHAR, target VARCHAR, symbol VARCHAR',
        [
            ('app/main.py', 'db/store.py', 'store.lookup'),
            ('src/M.java', 'src/y.rs', 'run'),
            ('src/z.cpp', 'src/K.kt', 'go'),
            ('src/z.cpp', 'web/lib.js', 'go'),
            ('tools/risky.py', 'src/y.rs', 'subprocess.run'),
            ('web/app.js', 'src/K.kt', 'go'),
            ('web/app.js', 'web/lib.js', 'go'),
            ('web/lib.js', 'src/K.kt', 'go'),
            ('web/lib.js', 'web/app.js', 'paint'),
        ],
    ),
    'code_module_edges': (
        'source VARCHAR, target VARCHAR',
        [
            ('app/flow.py', 'flask'),
            ('app/flow.py', 'flask.request'),
            ('app/main.py', 'app.util.clean'),
            ('app/main.py', 'app/util.py'),
            ('app/main.py', 'db/store.py'),
            ('app/main.py', 'flask'),
            ('app/main.py', 'flask.request'),
            ('app/main.py', 'os'),
            ('app/util.py', 'app/main.py'),
            ('db/store.py', 'app/__init__.py'),
            ('db/store.py', 'app/util.py'),
            ('db/store.py', 'sqlite3'),
        ],
    ),
    'code_dead_ratio': (
        'ratio DOUBLE',
        [
            (0.027777777777777776,),
        ],
    ),
    'code_health': (
        'lines BIGINT, layers BIGINT, clear BOOLEAN, smells DOUBLE, structure DOUBLE',
        [
            (110, 4, False, 63.6364, 85.0),
        ],
    ),
    'code_hours': (
        'path VARCHAR, hours DOUBLE',
        [
            ('tools/risky.py', 5.3333),
            ('tools/slow.py', 12.3333),
        ],
    ),
    'code_deduplicated': (
        'path VARCHAR, line BIGINT, type VARCHAR, evidence VARCHAR',
        [
            ('app/flow.py', 11, 'sql-injection', None),
            ('app/flow.py', 8, 'path-traversal', None),
            ('db/store.py', 7, 'sql-injection', 'app/main.py'),
        ],
    ),
    'code_report_json': (
        'json VARCHAR',
        [
            ('{"files":18,"lines":161,"functions":27,"third_party":"flask"}',),
        ],
    ),
    'code_brief_text': (
        'text VARCHAR',
        [
            ('path=README.md  symbols=  summary=A web server | with login over a database\npath=requirements.txt  symbols=  summary=flask | numpy==1.0\npath=web/app.js  symbols=View,add,draw,paint  summary=\npath=web/lib.js  symbols=draw,go  summary=',),
        ],
    ),
    'code_liveness': (
        'source VARCHAR, target VARCHAR, state VARCHAR',
        [
            ('app/flow.py', 'flask', 'dead'),
            ('app/flow.py', 'flask.request', 'dead'),
            ('app/main.py', 'app.util.clean', 'dead'),
            ('app/main.py', 'app/util.py', 'alive'),
            ('app/main.py', 'db/store.py', 'alive'),
            ('app/main.py', 'flask', 'dead'),
            ('app/main.py', 'flask.request', 'dead'),
            ('app/main.py', 'os', 'dead'),
            ('app/util.py', 'app/main.py', 'alive'),
            ('db/store.py', 'app/__init__.py', 'stale'),
            ('db/store.py', 'app/util.py', 'stale'),
            ('db/store.py', 'sqlite3', 'dead'),
        ],
    ),
    'code_new_edges': (
        'source VARCHAR, target VARCHAR',
        [
            ('app/main.py', 'app.util'),
            ('app/main.py', 'app.util.clean'),
            ('app/main.py', 'db.store'),
            ('app/main.py', 'flask'),
            ('app/main.py', 'flask.request'),
            ('app/main.py', 'new'),
            ('app/main.py', 'os'),
        ],
    ),
    'code_paths': (
        'path VARCHAR, test BOOLEAN, core BOOLEAN',
        [
            ('a/b.test.js', True, False),
            ('a/plain.py', False, False),
            ('a/shell/b.js', False, True),
            ('a/test_b.py', True, False),
            ('lib/auth_x.py', False, True),
            ('tests/a.py', True, False),
            (None, None, None),
        ],
    ),
    'tree_backtrack': (
        'at BIGINT, id BIGINT, up INTEGER',
        [
            (4, 2, 1),
            (6, 2, 2),
        ],
    ),
    'tree_dead': (
        'id BIGINT, status VARCHAR',
        [
            (1, 'expanded'),
            (2, 'dead_end'),
            (3, 'open'),
            (4, 'dead_end'),
            (5, 'dead_end'),
            (6, 'dead_end'),
        ],
    ),
    'tree_text': (
        'text VARCHAR',
        [
            ('+ root\n  + one [0.5]\n    x three [0.2]\n    * four [0.8]\n      o five\n  - two [0.9]',),
        ],
    ),
    'tree_similarity': (
        'a VARCHAR, b VARCHAR, similarity DOUBLE',
        [
            ('', 'x', 0.0),
            ('A  B c', 'a b C', 1.0),
            ('a cat sat', 'a cat sat', 1.0),
            ('abab', 'ab', 0.5774),
            ('night', 'nacht', 0.25),
        ],
    ),
    'tree_converged': (
        'layer INTEGER, nodes BIGINT, alike BIGINT, converged BOOLEAN',
        [
            (1, 1, 1, True),
            (2, 2, 1, False),
            (3, 1, 0, None),
        ],
    ),
}
