"""Word lists, lookup tables and patterns that results depend on, in their natural order."""

# fixed values: token pattern of the C lexer; comments are tokens that are dropped, anything else non-blank is one token
LEX_PATTERN = (
    r"""(?s)"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])'|//[^\n]*|/\*.*?\*/|<operator>\.[A-Za-z_][A-Za-z_0-9]*"""
    r"""|0[xX][0-9A-Fa-f]+(?:[uUlL]+)?|(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)[fFlL]?|\d+\.\d*[fFlL]?|\d+(?:[uUlL]+)?"""
    r"""|[A-Za-z_][A-Za-z_0-9]*|==|!=|<=|>=|->|\+\+|--|&&|\|\||<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|::"""
    r"""|[{}()\[\];,.?:~!%^&*+\-=/<>|]|\S"""
)

# fixed values: keywords and basic types of C
C_KEYWORDS = [
    "auto", "break", "case", "char", "const", "continue", "default", "do", "double", "else", "enum", "extern", "float", "for", "goto",
    "if", "inline", "int", "long", "register", "restrict", "return", "short", "signed", "sizeof", "static", "struct", "switch", "typedef",
    "union", "unsigned", "void", "volatile", "while",
]
BASIC_TYPES = [
    "bool", "char", "double", "float", "int", "long", "short", "signed", "size_t", "ssize_t", "uint8_t", "uint16_t", "uint32_t",
    "uint64_t", "int8_t", "int16_t", "int32_t", "int64_t", "unsigned", "void",
]

# fixed values: tags of identifier parts
SEMANTIC_TAGS = {
    "SEM_SRC": ["src", "source", "from", "input", "in"],
    "SEM_DST": ["dst", "dest", "destination", "to", "output", "out"],
    "SEM_LEN": ["len", "length", "nbytes", "bytes"],
    "SEM_SIZE": ["size", "sz", "capacity", "cap"],
    "SEM_COUNT": ["count", "cnt", "num", "nb", "nr"],
    "SEM_INDEX": ["idx", "index", "i", "j", "k", "pos"],
    "SEM_OFFSET": ["offset", "off", "start", "end"],
    "SEM_BUF": ["buf", "buffer", "data", "packet", "payload"],
    "SEM_PTR": ["ptr", "p", "pointer"],
    "SEM_DIM": ["width", "height", "stride", "pitch"],
}

# fixed values: categories of standard calls (their names are kept beside) and of wrappers (the category alone)
STANDARD_APIS = {
    "API_COPY": ["memcpy", "memmove", "strcpy", "strncpy", "strcat"],
    "API_FORMAT": ["sprintf", "snprintf"],
    "API_LEN": ["strlen"],
    "API_ALLOC": ["malloc", "calloc"],
    "API_REALLOC": ["realloc"],
    "API_FREE": ["free"],
    "API_INPUT": ["gets", "scanf", "read", "recv", "fread"],
    "API_MEMSET": ["memset"],
    "API_OUTPUT": ["fwrite"],
    "API_OPEN": ["open"],
    "API_CLOSE": ["close"],
}
WRAPPER_APIS = {
    "API_ALLOC": ["av_malloc", "av_mallocz", "g_malloc", "OPENSSL_malloc"],
    "API_REALLOC": ["av_realloc", "g_realloc", "OPENSSL_realloc"],
    "API_FREE": ["OPENSSL_free"],
}

# fixed values: relations of each view, in the order of their ids
VIEW_RELATIONS = {
    "ast": ["AST"],
    "cfg": ["CFG"],
    "pdg": ["CDG", "REACHING_DEF"],
    "core-cpg": ["AST", "CFG", "CDG", "REACHING_DEF"],
    "dataflow-cpg": ["CFG", "CDG", "REACHING_DEF"],
    "slice-cpg": ["AST", "CFG", "CDG", "REACHING_DEF"],
}
AST_CHILD_LABELS = ["CALL", "FIELD_IDENTIFIER", "IDENTIFIER", "LITERAL", "LOCAL", "METHOD_PARAMETER_IN", "RETURN"]

# fixed values: substrings that make a call or an access risky
RISKY_CALLS = [
    "alloc", "calloc", "free", "gets", "malloc", "memcpy", "memmove", "read", "realloc", "recv", "scanf", "sprintf", "strcat", "strcpy",
    "strlen",
]
MEMORY_LABELS = ["CALL", "FIELD_IDENTIFIER", "IDENTIFIER", "LOCAL"]
MEMORY_SYNTAX = ["[", "->", "<operator>.fieldaccess", "<operator>.indirectfieldaccess", "<operator>.indirection", "<operator>.indexaccess"]
# fixed values: the shorter list that models are given seed types by
SEED_MEMORY_SYNTAX = ["[", "->", "*", "<operator>.indexaccess", "<operator>.fieldaccess"]

# fixed values: call families and operator names of the motif features
MOTIF_APIS = {
    "known_alloc_api": ["malloc", "calloc", "realloc", "av_malloc", "av_mallocz", "av_realloc"],
    "known_copy_api": ["memcpy", "memmove", "strcpy", "strncpy", "strcat", "sprintf"],
    "known_release_api": ["free", "av_free", "av_freep", "close"],
    "known_io_api": ["read", "write", "recv", "send", "scanf"],
}
MOTIF_OPERATORS = {
    "indirect_call": ["pointerCall"],
    "array_index": ["indexAccess"],
    "field_access": ["fieldAccess", "indirectFieldAccess"],
    "address_of": ["addressOf"],
    "integer_mul": ["multiplication"],
    "integer_sub": ["subtraction"],
    "division": ["division"],
    "modulo": ["modulo"],
    "bit_shift": ["shiftLeft", "arithmeticShiftRight", "logicalShiftRight"],
}
ERROR_RETURNS = ["error", "invalid", "einval", "averror", "return -"]
STRUCTURE_FEATURES = ["num_ast_edges", "num_cfg_edges", "num_cdg_edges", "num_reaching_def_edges"]
SCALE_FEATURES = ["num_nodes", "num_edges", "branch_count", "loop_count", "return_count", "error_return_count"]

# fixed values: evidence categories of a source line, the first that matches its lower case
CODE_CATEGORIES = [
    ("copy/API", r"\b(memcpy|memmove|memset|strcpy|strncpy|snprintf|sprintf)\b"),
    ("alloc/free", r"\b(malloc|calloc|realloc|free|g_free|alloc|av_free)\b"),
    ("runtime/wait", r"(qtest_|qmp_|eventwait|usleep|wait|cleanup|qtest_start|qmp)"),
    ("buffer/index", r"(\->|\[[^\]]+\]|\*|ptr|buf|dst|src|size|stride|width|height|offset|linesize)"),
    ("control", r"\b(if|for|while|do|switch|case)\b"),
    ("exit", r"\b(return|goto|break|continue)\b"),
]

# fixed values: what must not be left in anonymised texts
STRING_LEAK = r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])'"""
PATH_LEAK = r"([A-Za-z]:\\|/home/|/tmp/|/usr/|\\\\)"

# fixed values: weights of the parts of a pair's score, and slices of the ranked negatives
PAIR_WEIGHTS = {"motif": 0.40, "structure": 0.30, "scale": 0.15, "false_positive": 0.15}
BANK_SLICE, REVIEW_SHARE, FALSE_POSITIVE_SHARE = (0.05, 0.30), 0.05, 0.10
