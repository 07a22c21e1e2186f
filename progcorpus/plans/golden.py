"""Expected values per program template, for the oracles.

Computed from our own templates (``sources.fixtures.TEMPLATES``, with
``{f}`` = ``task_0``; positions and counts do not depend on the name) with
the Python standard library tokenizer and parser; ``tests/test_golden.py``
recomputes them.  Relevant parts and classes were worked out by hand from the
extraction and equivalence rules.
"""

# Per-template golden values (stdlib tokenizer / parser).
GOLDEN = {0: {'tokenizes': True,
     'compile_error': None,
     'n_nodes': 17,
     'variables': 'a b c',
     'multi_function': False,
     'first_function': 'task_0',
     'n_tokens': 29,
     'operators': {'+': '18'},
     'numbers': {},
     'strings': {},
     'variable_locations': {'a': '4,16', 'b': '7,20', 'c': '12,25'},
     'defs': 1,
     'def_positions': '0',
     'max_indent_depth': 1,
     'operator_seq': '+',
     'adjacency_md5': '85d6a864edfb2173472e9d2aff9c7549',
     'tree_functions': [('task_0', 'def task_0(a, b):\n    c = a + b\n    return c')],
     'positional_args': 'a b',
     'n_indent': 1,
     'n_dedent': 1},
 1: {'tokenizes': True,
     'compile_error': None,
     'n_nodes': 17,
     'variables': 'x y total',
     'multi_function': False,
     'first_function': 'task_0',
     'n_tokens': 29,
     'operators': {'+': '18'},
     'numbers': {},
     'strings': {},
     'variable_locations': {'x': '4,16', 'y': '7,20', 'total': '12,25'},
     'defs': 1,
     'def_positions': '0',
     'max_indent_depth': 1,
     'operator_seq': '+',
     'adjacency_md5': '85d6a864edfb2173472e9d2aff9c7549',
     'tree_functions': [('task_0', 'def task_0(x, y):\n    total = x + y\n    return total')],
     'positional_args': 'x y',
     'n_indent': 1,
     'n_dedent': 1},
 2: {'tokenizes': True,
     'compile_error': None,
     'n_nodes': 12,
     'variables': 'a b',
     'multi_function': False,
     'first_function': 'task_0',
     'n_tokens': 22,
     'operators': {'+': '16'},
     'numbers': {},
     'strings': {},
     'variable_locations': {'a': '4,14', 'b': '7,18'},
     'defs': 1,
     'def_positions': '0',
     'max_indent_depth': 1,
     'operator_seq': '+',
     'adjacency_md5': '538cc8bca97f3e9760656e66ee418a0b',
     'tree_functions': [('task_0', 'def task_0(a, b):\n    return a + b')],
     'positional_args': 'a b',
     'n_indent': 1,
     'n_dedent': 1},
 3: {'tokenizes': True,
     'compile_error': None,
     'n_nodes': 19,
     'variables': 'a b c',
     'multi_function': False,
     'first_function': 'task_0',
     'n_tokens': 35,
     'operators': {'+': '24'},
     'numbers': {},
     'strings': {'"""Add two numbers."""': '12'},
     'variable_locations': {'a': '4,22', 'b': '7,26', 'c': '18,31'},
     'defs': 1,
     'def_positions': '0',
     'max_indent_depth': 1,
     'operator_seq': '+',
     'adjacency_md5': 'd2a5bedd01cb06965e0ecb8ed5c0a8f1',
     'tree_functions': [('task_0',
                         'def task_0(a, b):\n'
                         '    """Add two numbers."""\n'
                         '    # add\n'
                         '    c = a + b\n'
                         '    return c')],
     'positional_args': 'a b',
     'n_indent': 1,
     'n_dedent': 1},
 4: {'tokenizes': True,
     'compile_error': None,
     'n_nodes': 24,
     'variables': 'u a b',
     'multi_function': True,
     'first_function': 'helper',
     'n_tokens': 44,
     'operators': {'**': '13', '//': '38'},
     'numbers': {'2': '15'},
     'strings': {},
     'variable_locations': {'u': '4,11', 'a': '23,35', 'b': '26,40'},
     'defs': 2,
     'def_positions': '0,19',
     'max_indent_depth': 1,
     'operator_seq': '** //',
     'adjacency_md5': '6dd966bebe23f62385dc8a6a7ac14a77',
     'tree_functions': [('helper', 'def helper(u):\n    return u ** 2'),
                        ('task_0', 'def task_0(a, b):\n    return helper(a) // b')],
     'positional_args': 'a b',
     'n_indent': 2,
     'n_dedent': 2},
 5: {'tokenizes': True,
     'compile_error': None,
     'n_nodes': 21,
     'variables': 'a b k',
     'multi_function': True,
     'first_function': 'task_0',
     'n_tokens': 40,
     'operators': {'-': '25'},
     'numbers': {},
     'strings': {},
     'variable_locations': {'a': '4,35', 'b': '7,27', 'k': '16,23'},
     'defs': 2,
     'def_positions': '0,12',
     'max_indent_depth': 2,
     'operator_seq': '-',
     'adjacency_md5': 'f4a6c6c04a9e950925614dd9ab237a1f',
     'tree_functions': [('task_0',
                         'def task_0(a, b):\n    def inner(k):\n        return k - b\n    return inner(a)'),
                        ('inner', 'def inner(k):\n        return k - b')],
     'positional_args': 'a b',
     'n_indent': 2,
     'n_dedent': 2},
 6: {'tokenizes': True,
     'compile_error': 'SyntaxError',
     'n_nodes': 0,
     'variables': '',
     'multi_function': False,
     'first_function': 'task_0',
     'n_tokens': 21,
     'operators': {'+': '15'},
     'numbers': {},
     'strings': {},
     'variable_locations': {},
     'defs': 1,
     'def_positions': '0',
     'max_indent_depth': 1,
     'operator_seq': '+',
     'adjacency_md5': None,
     'tree_functions': [],
     'positional_args': None,
     'n_indent': 1,
     'n_dedent': 1},
 7: {'tokenizes': True,
     'compile_error': 'IndentationError',
     'n_nodes': 0,
     'variables': '',
     'multi_function': False,
     'first_function': 'task_0',
     'n_tokens': 20,
     'operators': {'+': '15'},
     'numbers': {},
     'strings': {},
     'variable_locations': {},
     'defs': 1,
     'def_positions': '0',
     'max_indent_depth': 0,
     'operator_seq': '+',
     'adjacency_md5': None,
     'tree_functions': [],
     'positional_args': None,
     'n_indent': 0,
     'n_dedent': 0},
 8: {'tokenizes': False,
     'compile_error': 'SyntaxError',
     'n_nodes': 0,
     'variables': '',
     'multi_function': False,
     'first_function': '',
     'n_tokens': 0,
     'operators': {},
     'numbers': {},
     'strings': {},
     'variable_locations': {},
     'defs': 0,
     'def_positions': '',
     'max_indent_depth': 0,
     'operator_seq': '',
     'adjacency_md5': None,
     'tree_functions': [],
     'positional_args': None,
     'n_indent': 0,
     'n_dedent': 0},
 9: {'tokenizes': True,
     'compile_error': None,
     'n_nodes': 12,
     'variables': 'a b',
     'multi_function': False,
     'first_function': 'task_0',
     'n_tokens': 20,
     'operators': {'+': '15'},
     'numbers': {},
     'strings': {},
     'variable_locations': {'a': '4,13', 'b': '7,17'},
     'defs': 1,
     'def_positions': '0',
     'max_indent_depth': 0,
     'operator_seq': '+',
     'adjacency_md5': '538cc8bca97f3e9760656e66ee418a0b',
     'tree_functions': [('task_0', 'def task_0(a, b): return a + b')],
     'positional_args': 'a b',
     'n_indent': 0,
     'n_dedent': 0},
 10: {'tokenizes': True,
      'compile_error': None,
      'n_nodes': 15,
      'variables': 'a b',
      'multi_function': True,
      'first_function': 'task_0',
      'n_tokens': 35,
      'operators': {},
      'numbers': {},
      'strings': {},
      'variable_locations': {'a': '4,14,21', 'b': '7,24,31'},
      'defs': 2,
      'def_positions': '0,17',
      'max_indent_depth': 1,
      'operator_seq': '',
      'adjacency_md5': '9e9d05734352748c3758b4806da085e1',
      'tree_functions': [('task_0', 'def task_0(a, b):\n    return a'),
                         ('task_0', 'def task_0(a, b):\n    return b')],
      'positional_args': 'a b',
      'n_indent': 2,
      'n_dedent': 2},
 11: {'tokenizes': True,
      'compile_error': None,
      'n_nodes': 44,
      'variables': 'items limit out it s',
      'multi_function': False,
      'first_function': 'task_0',
      'n_tokens': 71,
      'operators': {'<=': '34', '!=': '42'},
      'numbers': {'0': '44'},
      'strings': {'"items"': '62'},
      'variable_locations': {'items': '4,26',
                             'limit': '7,36',
                             'out': '12,48,67',
                             'it': '22,32,40,52',
                             's': '58'},
      'defs': 1,
      'def_positions': '0',
      'max_indent_depth': 3,
      'operator_seq': '<= !=',
      'adjacency_md5': '8f70b917e3b7f724b1750a5138230c73',
      'tree_functions': [('task_0',
                          'def task_0(items, limit):\n'
                          '    out = []\n'
                          '    for it in items:\n'
                          '        if it <= limit and it != 0:\n'
                          '            out.append(it)\n'
                          '    s = "items"\n'
                          '    return out')],
      'positional_args': 'items limit',
      'n_indent': 3,
      'n_dedent': 3},
 12: {'tokenizes': True,
      'compile_error': None,
      'n_nodes': 12,
      'variables': 'a b',
      'multi_function': False,
      'first_function': 'other',
      'n_tokens': 22,
      'operators': {'+': '16'},
      'numbers': {},
      'strings': {},
      'variable_locations': {'a': '4,14', 'b': '7,18'},
      'defs': 1,
      'def_positions': '0',
      'max_indent_depth': 1,
      'operator_seq': '+',
      'adjacency_md5': '538cc8bca97f3e9760656e66ee418a0b',
      'tree_functions': [('other', 'def other(a, b):\n    return a + b')],
      'positional_args': None,
      'n_indent': 1,
      'n_dedent': 1},
 13: {'tokenizes': True,
      'compile_error': None,
      'n_nodes': 12,
      'variables': 'a b',
      'multi_function': False,
      'first_function': 'task_0',
      'n_tokens': 24,
      'operators': {},
      'numbers': {},
      'strings': {},
      'variable_locations': {'a': '6,16', 'b': '9,20'},
      'defs': 1,
      'def_positions': '2',
      'max_indent_depth': 1,
      'operator_seq': '',
      'adjacency_md5': '5c1b06001ba9b14a048f23a62436b0f3',
      'tree_functions': [('task_0', 'def task_0(a, b):\r\n    return a * b')],
      'positional_args': 'a b',
      'n_indent': 1,
      'n_dedent': 1},
 14: {'tokenizes': True,
      'compile_error': None,
      'n_nodes': 1,
      'variables': '',
      'multi_function': False,
      'first_function': '',
      'n_tokens': 1,
      'operators': {},
      'numbers': {},
      'strings': {},
      'variable_locations': {},
      'defs': 0,
      'def_positions': '',
      'max_indent_depth': 0,
      'operator_seq': '',
      'adjacency_md5': '53b3cae42737979c884275593a01f468',
      'tree_functions': [],
      'positional_args': None,
      'n_indent': 0,
      'n_dedent': 0},
 15: {'tokenizes': True,
      'compile_error': None,
      'n_nodes': 248,
      'variables': 'a b',
      'multi_function': False,
      'first_function': 'task_0',
      'n_tokens': 348,
      'operators': {'+': '18,29,40,51,62,73,84,95,106,117,128,139,150,161,172,183,194,205,216,227,238,249,260,271,282,293,304,315,326,337'},
      'numbers': {'1': '20,31,42,53,64,75,86,97,108,119,130,141,152,163,174,185,196,207,218,229,240,251,262,273,284,295,306,317,328,339'},
      'strings': {},
      'variable_locations': {'a': '4,12,16,23,27,34,38,45,49,56,60,67,71,78,82,89,93,100,104,111,115,122,126,133,137,144,148,155,159,166,170,177,181,188,192,199,203,210,214,221,225,232,236,243,247,254,258,265,269,276,280,287,291,298,302,309,313,320,324,331,335,344',
                             'b': '7'},
      'defs': 1,
      'def_positions': '0',
      'max_indent_depth': 1,
      'operator_seq': '+ + + + + + + + + + + + + + + + + + + + + + + + + + + + + +',
      'adjacency_md5': 'dbae1e741bc22483d867c850eabc6747',
      'tree_functions': [('task_0',
                          'def task_0(a, b):\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    a = a + 1\n'
                          '    return a')],
      'positional_args': 'a b',
      'n_indent': 1,
      'n_dedent': 1},
 16: {'tokenizes': True,
     'compile_error': None,
     'n_nodes': 26,
     'variables': 'a b',
     'multi_function': True,
     'first_function': 'helper',
     'n_tokens': 33,
     'operators': {},
     'numbers': {},
     'strings': {'f"{helper(a)}#{d["#k"]}"': '29'},
     'variable_locations': {'a': '4,11,19', 'b': '22'},
     'defs': 2,
     'def_positions': '0,15',
     'max_indent_depth': 1,
     'operator_seq': '',
     'adjacency_md5': 'b185a1dda1665bcb991ceaaf87a73736',
     'tree_functions': [('helper', 'def helper(a):\n    return a'),
                        ('task_0', 'def task_0(a, b):\n    return f"{helper(a)}#{d["#k"]}"')],
     'positional_args': 'a b',
     'n_indent': 2,
     'n_dedent': 2},
 17: {'tokenizes': True,
     'compile_error': None,
     'n_nodes': 26,
     'variables': 'a x',
     'multi_function': True,
     'first_function': 'helper',
     'n_tokens': 33,
     'operators': {},
     'numbers': {},
     'strings': {'f"{helper(x)}#{d["#k"]}"': '29'},
     'variable_locations': {'a': '4,11,22', 'x': '19'},
     'defs': 2,
     'def_positions': '0,15',
     'max_indent_depth': 1,
     'operator_seq': '',
     'adjacency_md5': 'b185a1dda1665bcb991ceaaf87a73736',
     'tree_functions': [('helper', 'def helper(a):\n    return a'),
                        ('task_0', 'def task_0(x, a):\n    return f"{helper(x)}#{d["#k"]}"')],
     'positional_args': 'x a',
     'n_indent': 2,
     'n_dedent': 2},
 18: {'tokenizes': True,
     'compile_error': None,
     'n_nodes': 16,
     'variables': 'max',
     'multi_function': True,
     'first_function': 'helper',
     'n_tokens': 37,
     'operators': {},
     'numbers': {'1': '12', '2': '15'},
     'strings': {},
     'variable_locations': {'max': '10,24'},
     'defs': 2,
     'def_positions': '0,20',
     'max_indent_depth': 1,
     'operator_seq': '',
     'adjacency_md5': '533b296bb4205725fbcf4198253b649d',
     'tree_functions': [('helper', 'def helper():\n    return max(1, 2)'),
                        ('task_0', 'def task_0(max):\n    return helper()')],
     'positional_args': 'max',
     'n_indent': 2,
     'n_dedent': 2},
 19: {'tokenizes': True,
     'compile_error': None,
     'n_nodes': 16,
     'variables': 'min',
     'multi_function': True,
     'first_function': 'helper',
     'n_tokens': 37,
     'operators': {},
     'numbers': {'1': '12', '2': '15'},
     'strings': {},
     'variable_locations': {'min': '10,24'},
     'defs': 2,
     'def_positions': '0,20',
     'max_indent_depth': 1,
     'operator_seq': '',
     'adjacency_md5': '533b296bb4205725fbcf4198253b649d',
     'tree_functions': [('helper', 'def helper():\n    return min(1, 2)'),
                        ('task_0', 'def task_0(min):\n    return helper()')],
     'positional_args': 'min',
     'n_indent': 2,
     'n_dedent': 2}}

# Relevant part per template ("{f}" = the question's function),
# and equivalence class inside a question (None = no class, dropped).
RELEVANT = {
    0: "WHOLE", 1: "WHOLE", 2: "WHOLE", 3: "WHOLE",
    4: "def helper(u):\n    return u ** 2\ndef {f}(a, b):\n    return helper(a) // b",
    5: "def inner(k):\n        return k - b\n"
       "def {f}(a, b):\n    def inner(k):\n        return k - b\n    return inner(a)",
    6: "WHOLE", 7: "def {f}(a, b):", 8: "", 9: "WHOLE",
    10: "def {f}(a, b):\n    return b", 11: "WHOLE", 12: "",
    13: "def {f}(a, b):\r\n    return a * b", 14: "", 15: "WHOLE",
    16: 'def helper(a):\n    return a\ndef {f}(a, b):\n    return f"{helper(a)}#{d["#k"]}"',
    17: 'def helper(a):\n    return a\ndef {f}(x, a):\n    return f"{helper(x)}#{d["#k"]}"',
    18: "def helper():\n    return max(1, 2)\ndef {f}(max):\n    return helper()",
    19: "def helper():\n    return min(1, 2)\ndef {f}(min):\n    return helper()",
}
CLASS = {0: "A", 1: "A", 2: "B", 3: "C", 4: "D", 5: "E", 6: None, 7: None, 8: None, 9: "B",
         10: "F", 11: "G", 12: None, 13: "H", 14: None, 15: "I", 16: "J", 17: "J", 18: "K", 19: "L"}

# Functions of each template in source order, (name, text);
# "WHOLE" = from the first "def" to the end of the text.
FUNCS = {
    0: [("{f}", "WHOLE")], 1: [("{f}", "WHOLE")], 2: [("{f}", "WHOLE")], 3: [("{f}", "WHOLE")],
    4: [("helper", "def helper(u):\n    return u ** 2\n\n"), ("{f}", "def {f}(a, b):\n    return helper(a) // b")],
    5: [("{f}", "WHOLE"), ("inner", "def inner(k):\n        return k - b\n    ")],
    6: [("{f}", "WHOLE")], 7: [("{f}", "def {f}(a, b):\n")], 8: [], 9: [("{f}", "WHOLE")],
    10: [("{f}", "def {f}(a, b):\n    return a\n"), ("{f}", "def {f}(a, b):\n    return b")],
    11: [("{f}", "WHOLE")], 12: [("other", "WHOLE")], 13: [("{f}", "def {f}(a, b):\r\n    return a * b\r\n")],
    14: [], 15: [("{f}", "WHOLE")],
    16: [("helper", "def helper(a):\n    return a\n\n"), ("{f}", 'def {f}(a, b):\n    return f"{helper(a)}#{d["#k"]}"')],
    17: [("helper", "def helper(a):\n    return a\n\n"), ("{f}", 'def {f}(x, a):\n    return f"{helper(x)}#{d["#k"]}"')],
    18: [("helper", "def helper():\n    return max(1, 2)\n\n"), ("{f}", "def {f}(max):\n    return helper()")],
    19: [("helper", "def helper():\n    return min(1, 2)\n\n"), ("{f}", "def {f}(min):\n    return helper()")],
}
# Cleaned text per template (None = does not tokenize).
CLEAN = {
    0: "WHOLE", 1: "WHOLE", 2: "WHOLE", 3: "def {f}(a, b):\n    c = a + b\n    return c",
    4: "def helper(u):\n    return u ** 2\ndef {f}(a, b):\n    return helper(a) // b",
    5: "WHOLE", 6: "WHOLE", 7: "WHOLE", 8: None, 9: "WHOLE", 10: "WHOLE", 11: "WHOLE", 12: "WHOLE",
    13: "def {f}(a, b):\n    return a * b", 14: "", 15: "WHOLE",
    16: 'def helper(a):\n    return a\ndef {f}(a, b):\n    return f"{helper(a)}#{d["#k"]}"',
    17: 'def helper(a):\n    return a\ndef {f}(x, a):\n    return f"{helper(x)}#{d["#k"]}"',
    18: "def helper():\n    return max(1, 2)\ndef {f}(max):\n    return helper()",
    19: "def helper():\n    return min(1, 2)\ndef {f}(min):\n    return helper()",
}

# Whitespace-preserving token stream per template (stdlib tokenizer).
TOKENS = {0: [('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'task_0'), ('OP', '('), ('NAME', 'a'), ('OP', ','),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('OP', ')'), ('OP', ':'), ('NEWLINE', '\n'), ('INDENT', '    '),
     ('NAME', 'c'), ('UNIMPORTANT_WS', ' '), ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'),
     ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('NEWLINE', '\n'),
     ('UNIMPORTANT_WS', '    '), ('NAME', 'return'), ('UNIMPORTANT_WS', ' '), ('NAME', 'c'), ('NEWLINE', ''),
     ('DEDENT', ''), ('ENDMARKER', '')],
 1: [('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'task_0'), ('OP', '('), ('NAME', 'x'), ('OP', ','),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'y'), ('OP', ')'), ('OP', ':'), ('NEWLINE', '\n'), ('INDENT', '    '),
     ('NAME', 'total'), ('UNIMPORTANT_WS', ' '), ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'x'),
     ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '), ('NAME', 'y'), ('NEWLINE', '\n'),
     ('UNIMPORTANT_WS', '    '), ('NAME', 'return'), ('UNIMPORTANT_WS', ' '), ('NAME', 'total'),
     ('NEWLINE', ''), ('DEDENT', ''), ('ENDMARKER', '')],
 2: [('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'task_0'), ('OP', '('), ('NAME', 'a'), ('OP', ','),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('OP', ')'), ('OP', ':'), ('NEWLINE', '\n'), ('INDENT', '    '),
     ('NAME', 'return'), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('NEWLINE', ''), ('DEDENT', ''), ('ENDMARKER', '')],
 3: [('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'task_0'), ('OP', '('), ('NAME', 'a'), ('OP', ','),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('OP', ')'), ('OP', ':'), ('NEWLINE', '\n'), ('INDENT', '    '),
     ('STRING', '"""Add two numbers."""'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '),
     ('COMMENT', '# add'), ('NL', '\n'), ('UNIMPORTANT_WS', '    '), ('NAME', 'c'), ('UNIMPORTANT_WS', ' '),
     ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '),
     ('NAME', 'return'), ('UNIMPORTANT_WS', ' '), ('NAME', 'c'), ('NEWLINE', ''), ('DEDENT', ''),
     ('ENDMARKER', '')],
 4: [('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'helper'), ('OP', '('), ('NAME', 'u'), ('OP', ')'),
     ('OP', ':'), ('NEWLINE', '\n'), ('INDENT', '    '), ('NAME', 'return'), ('UNIMPORTANT_WS', ' '),
     ('NAME', 'u'), ('UNIMPORTANT_WS', ' '), ('OP', '**'), ('UNIMPORTANT_WS', ' '), ('NUMBER', '2'),
     ('NEWLINE', '\n'), ('NL', '\n'), ('DEDENT', ''), ('NAME', 'def'), ('UNIMPORTANT_WS', ' '),
     ('NAME', 'task_0'), ('OP', '('), ('NAME', 'a'), ('OP', ','), ('UNIMPORTANT_WS', ' '), ('NAME', 'b'),
     ('OP', ')'), ('OP', ':'), ('NEWLINE', '\n'), ('INDENT', '    '), ('NAME', 'return'),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'helper'), ('OP', '('), ('NAME', 'a'), ('OP', ')'),
     ('UNIMPORTANT_WS', ' '), ('OP', '//'), ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('NEWLINE', ''),
     ('DEDENT', ''), ('ENDMARKER', '')],
 5: [('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'task_0'), ('OP', '('), ('NAME', 'a'), ('OP', ','),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('OP', ')'), ('OP', ':'), ('NEWLINE', '\n'), ('INDENT', '    '),
     ('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'inner'), ('OP', '('), ('NAME', 'k'), ('OP', ')'),
     ('OP', ':'), ('NEWLINE', '\n'), ('INDENT', '        '), ('NAME', 'return'), ('UNIMPORTANT_WS', ' '),
     ('NAME', 'k'), ('UNIMPORTANT_WS', ' '), ('OP', '-'), ('UNIMPORTANT_WS', ' '), ('NAME', 'b'),
     ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '), ('DEDENT', ''), ('NAME', 'return'),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'inner'), ('OP', '('), ('NAME', 'a'), ('OP', ')'), ('NEWLINE', ''),
     ('DEDENT', ''), ('ENDMARKER', '')],
 6: [('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'task_0'), ('OP', '('), ('NAME', 'a'), ('OP', ','),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('OP', ')'), ('NEWLINE', '\n'), ('INDENT', '    '),
     ('NAME', 'return'), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('NEWLINE', ''), ('DEDENT', ''), ('ENDMARKER', '')],
 7: [('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'task_0'), ('OP', '('), ('NAME', 'a'), ('OP', ','),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('OP', ')'), ('OP', ':'), ('NEWLINE', '\n'), ('NAME', 'return'),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '),
     ('NAME', 'b'), ('NEWLINE', ''), ('ENDMARKER', '')],
 8: [],
 9: [('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'task_0'), ('OP', '('), ('NAME', 'a'), ('OP', ','),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('OP', ')'), ('OP', ':'), ('UNIMPORTANT_WS', ' '),
     ('NAME', 'return'), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('NEWLINE', ''), ('ENDMARKER', '')],
 10: [('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'task_0'), ('OP', '('), ('NAME', 'a'), ('OP', ','),
      ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('OP', ')'), ('OP', ':'), ('NEWLINE', '\n'), ('INDENT', '    '),
      ('NAME', 'return'), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('NEWLINE', '\n'), ('DEDENT', ''),
      ('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'task_0'), ('OP', '('), ('NAME', 'a'), ('OP', ','),
      ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('OP', ')'), ('OP', ':'), ('NEWLINE', '\n'), ('INDENT', '    '),
      ('NAME', 'return'), ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('NEWLINE', ''), ('DEDENT', ''),
      ('ENDMARKER', '')],
 11: [('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'task_0'), ('OP', '('), ('NAME', 'items'),
      ('OP', ','), ('UNIMPORTANT_WS', ' '), ('NAME', 'limit'), ('OP', ')'), ('OP', ':'), ('NEWLINE', '\n'),
      ('INDENT', '    '), ('NAME', 'out'), ('UNIMPORTANT_WS', ' '), ('OP', '='), ('UNIMPORTANT_WS', ' '),
      ('OP', '['), ('OP', ']'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '), ('NAME', 'for'),
      ('UNIMPORTANT_WS', ' '), ('NAME', 'it'), ('UNIMPORTANT_WS', ' '), ('NAME', 'in'),
      ('UNIMPORTANT_WS', ' '), ('NAME', 'items'), ('OP', ':'), ('NEWLINE', '\n'), ('INDENT', '        '),
      ('NAME', 'if'), ('UNIMPORTANT_WS', ' '), ('NAME', 'it'), ('UNIMPORTANT_WS', ' '), ('OP', '<='),
      ('UNIMPORTANT_WS', ' '), ('NAME', 'limit'), ('UNIMPORTANT_WS', ' '), ('NAME', 'and'),
      ('UNIMPORTANT_WS', ' '), ('NAME', 'it'), ('UNIMPORTANT_WS', ' '), ('OP', '!='), ('UNIMPORTANT_WS', ' '),
      ('NUMBER', '0'), ('OP', ':'), ('NEWLINE', '\n'), ('INDENT', '            '), ('NAME', 'out'),
      ('OP', '.'), ('NAME', 'append'), ('OP', '('), ('NAME', 'it'), ('OP', ')'), ('NEWLINE', '\n'),
      ('UNIMPORTANT_WS', '    '), ('DEDENT', ''), ('DEDENT', ''), ('NAME', 's'), ('UNIMPORTANT_WS', ' '),
      ('OP', '='), ('UNIMPORTANT_WS', ' '), ('STRING', '"items"'), ('NEWLINE', '\n'),
      ('UNIMPORTANT_WS', '    '), ('NAME', 'return'), ('UNIMPORTANT_WS', ' '), ('NAME', 'out'),
      ('NEWLINE', ''), ('DEDENT', ''), ('ENDMARKER', '')],
 12: [('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'other'), ('OP', '('), ('NAME', 'a'), ('OP', ','),
      ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('OP', ')'), ('OP', ':'), ('NEWLINE', '\n'), ('INDENT', '    '),
      ('NAME', 'return'), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'),
      ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('NEWLINE', ''), ('DEDENT', ''), ('ENDMARKER', '')],
 13: [('NL', '\n'), ('NL', '\n'), ('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'task_0'), ('OP', '('),
      ('NAME', 'a'), ('OP', ','), ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('OP', ')'), ('OP', ':'),
      ('NEWLINE', '\r\n'), ('INDENT', '    '), ('NAME', 'return'), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'),
      ('UNIMPORTANT_WS', ' '), ('OP', '*'), ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('NEWLINE', '\r\n'),
      ('DEDENT', ''), ('ENDMARKER', '')],
 14: [('ENDMARKER', '')],
 15: [('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'task_0'), ('OP', '('), ('NAME', 'a'), ('OP', ','),
      ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('OP', ')'), ('OP', ':'), ('NEWLINE', '\n'), ('INDENT', '    '),
      ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'),
      ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'),
      ('UNIMPORTANT_WS', '    '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '='),
      ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '),
      ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '),
      ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'),
      ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '), ('NAME', 'a'),
      ('UNIMPORTANT_WS', ' '), ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '),
      ('OP', '+'), ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '),
      ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'),
      ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'),
      ('UNIMPORTANT_WS', '    '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '='),
      ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '),
      ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '),
      ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'),
      ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '), ('NAME', 'a'),
      ('UNIMPORTANT_WS', ' '), ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '),
      ('OP', '+'), ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '),
      ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'),
      ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'),
      ('UNIMPORTANT_WS', '    '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '='),
      ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '),
      ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '),
      ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'),
      ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '), ('NAME', 'a'),
      ('UNIMPORTANT_WS', ' '), ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '),
      ('OP', '+'), ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '),
      ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'),
      ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'),
      ('UNIMPORTANT_WS', '    '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '='),
      ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '),
      ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '),
      ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'),
      ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '), ('NAME', 'a'),
      ('UNIMPORTANT_WS', ' '), ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '),
      ('OP', '+'), ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '),
      ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'),
      ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'),
      ('UNIMPORTANT_WS', '    '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '='),
      ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '),
      ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '),
      ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'),
      ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '), ('NAME', 'a'),
      ('UNIMPORTANT_WS', ' '), ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '),
      ('OP', '+'), ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '),
      ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'),
      ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'),
      ('UNIMPORTANT_WS', '    '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '='),
      ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '),
      ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '),
      ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'),
      ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '), ('NAME', 'a'),
      ('UNIMPORTANT_WS', ' '), ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '),
      ('OP', '+'), ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '),
      ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'),
      ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'),
      ('UNIMPORTANT_WS', '    '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '='),
      ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '),
      ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '),
      ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'),
      ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '), ('NAME', 'a'),
      ('UNIMPORTANT_WS', ' '), ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '),
      ('OP', '+'), ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '),
      ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '='), ('UNIMPORTANT_WS', ' '), ('NAME', 'a'),
      ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '), ('NUMBER', '1'), ('NEWLINE', '\n'),
      ('UNIMPORTANT_WS', '    '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '='),
      ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('UNIMPORTANT_WS', ' '), ('OP', '+'), ('UNIMPORTANT_WS', ' '),
      ('NUMBER', '1'), ('NEWLINE', '\n'), ('UNIMPORTANT_WS', '    '), ('NAME', 'return'),
      ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('NEWLINE', ''), ('DEDENT', ''), ('ENDMARKER', '')],
 16: [('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'helper'), ('OP', '('), ('NAME', 'a'), ('OP', ')'),
     ('OP', ':'), ('NEWLINE', '\n'), ('INDENT', '    '), ('NAME', 'return'), ('UNIMPORTANT_WS', ' '),
     ('NAME', 'a'), ('NEWLINE', '\n'), ('NL', '\n'), ('DEDENT', ''), ('NAME', 'def'),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'task_0'), ('OP', '('), ('NAME', 'a'), ('OP', ','),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'b'), ('OP', ')'), ('OP', ':'), ('NEWLINE', '\n'), ('INDENT', '    '),
     ('NAME', 'return'), ('UNIMPORTANT_WS', ' '), ('STRING', 'f"{helper(a)}#{d["#k"]}"'), ('NEWLINE', ''),
     ('DEDENT', ''), ('ENDMARKER', '')],
 17: [('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'helper'), ('OP', '('), ('NAME', 'a'), ('OP', ')'),
     ('OP', ':'), ('NEWLINE', '\n'), ('INDENT', '    '), ('NAME', 'return'), ('UNIMPORTANT_WS', ' '),
     ('NAME', 'a'), ('NEWLINE', '\n'), ('NL', '\n'), ('DEDENT', ''), ('NAME', 'def'),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'task_0'), ('OP', '('), ('NAME', 'x'), ('OP', ','),
     ('UNIMPORTANT_WS', ' '), ('NAME', 'a'), ('OP', ')'), ('OP', ':'), ('NEWLINE', '\n'), ('INDENT', '    '),
     ('NAME', 'return'), ('UNIMPORTANT_WS', ' '), ('STRING', 'f"{helper(x)}#{d["#k"]}"'), ('NEWLINE', ''),
     ('DEDENT', ''), ('ENDMARKER', '')],
 18: [('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'helper'), ('OP', '('), ('OP', ')'), ('OP', ':'),
     ('NEWLINE', '\n'), ('INDENT', '    '), ('NAME', 'return'), ('UNIMPORTANT_WS', ' '), ('NAME', 'max'),
     ('OP', '('), ('NUMBER', '1'), ('OP', ','), ('UNIMPORTANT_WS', ' '), ('NUMBER', '2'), ('OP', ')'),
     ('NEWLINE', '\n'), ('NL', '\n'), ('DEDENT', ''), ('NAME', 'def'), ('UNIMPORTANT_WS', ' '),
     ('NAME', 'task_0'), ('OP', '('), ('NAME', 'max'), ('OP', ')'), ('OP', ':'), ('NEWLINE', '\n'),
     ('INDENT', '    '), ('NAME', 'return'), ('UNIMPORTANT_WS', ' '), ('NAME', 'helper'), ('OP', '('),
     ('OP', ')'), ('NEWLINE', ''), ('DEDENT', ''), ('ENDMARKER', '')],
 19: [('NAME', 'def'), ('UNIMPORTANT_WS', ' '), ('NAME', 'helper'), ('OP', '('), ('OP', ')'), ('OP', ':'),
     ('NEWLINE', '\n'), ('INDENT', '    '), ('NAME', 'return'), ('UNIMPORTANT_WS', ' '), ('NAME', 'min'),
     ('OP', '('), ('NUMBER', '1'), ('OP', ','), ('UNIMPORTANT_WS', ' '), ('NUMBER', '2'), ('OP', ')'),
     ('NEWLINE', '\n'), ('NL', '\n'), ('DEDENT', ''), ('NAME', 'def'), ('UNIMPORTANT_WS', ' '),
     ('NAME', 'task_0'), ('OP', '('), ('NAME', 'min'), ('OP', ')'), ('OP', ':'), ('NEWLINE', '\n'),
     ('INDENT', '    '), ('NAME', 'return'), ('UNIMPORTANT_WS', ' '), ('NAME', 'helper'), ('OP', '('),
     ('OP', ')'), ('NEWLINE', ''), ('DEDENT', ''), ('ENDMARKER', '')]}
