"""Tables of mathematical notation. All values here are fixed: results depend on them letter for letter."""

from __future__ import annotations

#: Greek letters of running text and the commands they become.
GREEK = {
    "α": "\\alpha", "β": "\\beta", "γ": "\\gamma", "Γ": "\\Gamma", "δ": "\\delta", "Δ": "\\Delta", "ε": "\\epsilon", "ζ": "\\zeta", "η": "\\eta", "θ": "\\theta",
    "ϑ": "\\vartheta", "κ": "\\kappa", "λ": "\\lambda", "μ": "\\mu", "ν": "\\nu", "π": "\\pi", "ρ": "\\rho", "σ": "\\sigma", "Σ": "\\Sigma", "τ": "\\tau",
    "φ": "\\phi", "ϕ": "\\phi", "Φ": "\\Phi", "χ": "\\chi", "ψ": "\\psi", "Ψ": "\\Psi", "ω": "\\omega", "Ω": "\\Omega", "ξ": "\\xi", "Ξ": "\\Xi",
}
#: Signs of running text and the commands they become.
SIGNS = {
    "∞": "\\infty", "→": "\\to", "←": "\\leftarrow", "↦": "\\mapsto", "⇒": "\\Rightarrow", "⇔": "\\Leftrightarrow", "∈": "\\in", "∉": "\\notin", "∋": "\\ni", "∪": "\\cup", "∩": "\\cap",
    "⊂": "\\subset", "⊆": "\\subseteq", "≤": "\\le", "≥": "\\ge", "≈": "\\approx", "≃": "\\simeq", "≡": "\\equiv", "≠": "\\ne", "±": "\\pm", "×": "\\times", "÷": "\\div",
    "∑": "\\sum", "∫": "\\int", "√": "\\sqrt", "∂": "\\partial", "∇": "\\nabla", "∅": "\\emptyset", "∗": "\\ast", "·": "\\cdot", "⋅": "\\cdot", "◦": "\\circ", "−": "-",
}
#: Greek letters after which a letter or number is a subscript.
SUBSCRIPTABLE = ["psi", "phi", "omega", "xi", "theta", "rho", "alpha", "beta", "gamma", "lambda", "mu", "sigma", "tau", "nu"]
#: Signs inside recognised formulas and the commands they become.
FORMULA_SIGNS = {
    "∑": "\\sum", "∫": "\\int", "√": "\\sqrt", "α": "\\alpha", "β": "\\beta", "γ": "\\gamma", "λ": "\\lambda", "μ": "\\mu", "π": "\\pi",
    "≤": "\\le", "≥": "\\ge", "≠": "\\ne", "≈": "\\approx", "→": "\\to", "∞": "\\infty", "·": "\\cdot", "×": "\\times", "−": "-",
}
#: Greek letters that symbols are normalised to a command for: by letter, by name, by command.
ALIASED = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "lambda": "λ", "mu": "μ", "sigma": "σ", "phi": "φ", "varphi": None, "theta": "θ", "omega": "ω"}
ALIASES = {x: f"\\{name}" for name, letter in ALIASED.items() for x in (name, letter, f"\\{name}") if x}
#: Commands that set a letter in a style of its own, which stays part of the symbol.
STYLES = ["mathbb", "mathcal", "mathfrak", "mathscr", "mathbf", "mathit", "mathrm"]
#: Commands that are operators.
OPERATOR_COMMANDS = (
    "frac tfrac dfrac cfrac binom tbinom dbinom sum prod int iint iiint oint sin cos tan log ln exp sqrt lim min max argmin argmax det ker dim deg gcd lcm mod bmod pmod Pr Re Im sup inf limsup liminf "
    "le leq ge geq ne neq approx sim equiv in notin subset subseteq supset supseteq cup cap setminus forall exists land lor neg to mapsto rightarrow leftarrow Rightarrow Leftrightarrow partial nabla "
    "cdot times div cdots dots ldots vdots ddots circ"
).split()
#: Further commands that are no symbols.
IGNORED_COMMANDS = "left right begin end mathrm mathbf mathit operatorname text mbox infty label tag quad qquad mathbb mathcal mathfrak mathscr".split()
#: Words that are no symbols.
IGNORED_WORDS = (
    "cases matrix pmatrix bmatrix vmatrix array align aligned equation split gather gathered operator operand lhs rhs root cdot times div circ cdots dots ldots vdots ddots quad qquad "
    "mathbb mathcal mathfrak mathscr mathbf mathit mathrm mbox where if then for and or"
).split()
#: Operators that stand between their operands.
INFIX = "=+-*/^<>"
#: Names of the operators of a formula: by its commands, then by its characters.
COMMAND_LABELS = [
    ("\\frac", "fraction"), ("\\sum", "sum"), ("\\prod", "product"), ("\\int", "integral"), ("\\lim", "limit"), ("\\sqrt", "sqrt"), ("\\circ", "composition"), ("\\cdots", "ellipsis"), ("\\dots", "ellipsis"),
    ("\\cup", "union"), ("\\cap", "intersection"), ("\\in", "membership"), ("\\to", "mapping"),
]
SIGN_LABELS = [("=", "equals"), ("+", "plus"), ("-", "minus"), ("^", "power")]
#: Classes of formulas, the first that fits: what formula and context hold, lower case (of equations the formula alone).
CLASSES = [
    ("set_or_logic_expression", ["\\forall", "\\exists", "\\in ", "\\notin", "\\subset", "\\supset", "\\cup", "\\cap", "there exists", "for all"]),
    ("mapping_or_implication", ["\\to", "\\mapsto", "\\rightarrow", "\\leftarrow"]),
    ("aggregation_or_calculus", ["\\sum", "sum", "\\prod", "product", "\\int", "integral", "\\lim", "limit", "\\min", "\\max", "\\argmin", "\\argmax"]),
    ("constraint_or_inequality", ["\\le", "\\ge", "\\ne", "\\approx", "\\sim", "\\equiv", "<", ">", "inequality"]),
    ("definition_or_equation", ["="]),
    ("notation_context", ["where", "denotes", "обозначает", "где", "пусть"]),
]
#: Phrases that introduce definitions.
DEFINITION_MARKERS = ["where", "denotes", "denote", "defined as", "is defined as", "let", "represents", "обозначает", "где", "определяется как", "задается как", "задаётся как", "пусть"]
THEOREM_MARKERS = ["theorem", "lemma", "proof", "теорема", "лемма", "доказательство"]
OPTIMUM_COMMANDS, OPTIMUM_MARKERS = ["\\min", "\\max", "\\argmin", "\\argmax"], ["minimize", "maximize", "arg min", "arg max", "минимиз", "максимиз"]
MATRIX_MARKERS = ["matrix", "pmatrix", "bmatrix", "array", "cases"]
#: Names of functions that do not count as words of prose.
MATH_WORDS = "arc arccos cos cosh det dim exp fix gcd inf ker lim log max min mod sec sech sin sup tan".split()
#: Titles that mark a section.
SECTION_TITLES = ["introduction", "background", "method", "methods", "results", "discussion", "conclusion", "references", "введение", "метод", "методы", "результаты", "обсуждение", "заключение", "выводы", "список литературы", "литература"]
#: Modes of a display and the older names they have.
MODES = {
    "metagraph_planetary": "metagraph_planetary_overview", "document_structure": "document_hierarchy", "formula_contexts": "formula_context", "formula_ast": "formula_ast_focus", "metaedges": "metaedges_view",
    "variable_neighborhood": "variable_focus", "graph_view": "overview", "metagraph_view": "metagraph_planetary_overview", "formula_context_view": "formula_context", "variable_neighborhood_view": "variable_focus",
    "extraction_evidence_view": "extraction_evidence", "document_structure_view": "document_hierarchy", "formula_semantic": "formula_semantic_network", "metagraph_overview": "metagraph_planetary_overview",
    "metagraph_fragments": "formula_ast_focus",
}
#: Weights of kinds of nodes and meta edges in a display.
NODE_WEIGHTS = {"document": 80, "section": 46, "paragraph": 22, "formula": 54, "symbol": 44, "context": 38, "definition": 42, "fragment": 16, "source": 12, "issue": 18, "metaedge": 36}
METAEDGE_WEIGHTS = {"definition_context": 2.1, "notation_scope": 1.8, "formula_dependency": 2.0, "paragraph_formula_context": 1.6, "extraction_evidence": 0.9}
METAVERTEX_BONUS = {"paper_metavertex": 35, "section_metavertex": 24, "formula_metavertex": 18}
#: Names of the sources of formulas.
SOURCES = {"regex": "ocr_regex", "text_pattern": "ocr_regex", "text_inline_pattern": "ocr_regex", "pp_structure_v3": "ppstructure", "pp_formula_net": "pp_formulanet", "detector": "heuristic"}
