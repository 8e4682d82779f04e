"""Prompt templates: own defaults, and those of a folder with one <name>.txt for each template that is replaced.

Fields are written {name}; {{ and }} are braces. A template must have all fields of its name and no others.
"""

from __future__ import annotations

import string
from pathlib import Path

from ..errors import UserError

#: Fields of each template.
FIELDS = {
    "reader": {"trechos", "pergunta"},
    "reader_alone": {"pergunta"},
    "question": {"tipo", "texto"},
    "unanswerable": {"texto"},
    "training": {"contexto", "pergunta"},
}

DEFAULTS = {
    "reader": """Passagens do documento, numeradas:

{trechos}

Tarefa: responder à pergunta abaixo só com o que as passagens dizem, em português e com no máximo duas frases.
Depois da resposta, indique entre parênteses de onde ela vem, na forma (seção N, p. N).
Quando as passagens não bastarem, a resposta inteira é: Não encontrado no manual.

Pergunta: {pergunta}
""",
    "reader_alone": """Tarefa: responder em português, com no máximo duas frases, sem consultar documentos.
Se a resposta não for conhecida, ela é: Não encontrado no manual.

Pergunta: {pergunta}
""",
    "question": """Passagem:
{texto}

Tarefa: formular, em português, uma pergunta do gênero {tipo} que a passagem acima responda sozinha, e sua resposta curta.
Saída: um único objeto JSON com os campos "pergunta" e "resposta", sem mais nada.
""",
    "unanswerable": """Passagem:
{texto}

Tarefa: formular, em português, uma pergunta verossímil sobre o assunto da passagem cuja resposta não está nela.
Saída: um único objeto JSON com o campo "pergunta", sem mais nada.
""",
    "training": """Passagens do documento, numeradas:

{contexto}

Pergunta: {pergunta}
""",
}


def fields(template: str) -> set[str]:
    """The names of a template's fields; a broken template is an error."""
    try:
        return {name for _, name, _, _ in string.Formatter().parse(template) if name is not None}
    except ValueError as e:
        raise UserError(f"broken template: {e}") from None


def checked(name: str, template: str) -> str:
    """The template; an error if its fields aren't those of its name."""
    found = fields(template)
    for label, wrong in (("lacks", FIELDS[name] - found), ("has unknown fields", found - FIELDS[name])):
        if wrong:
            raise UserError(f"template {name} {label}: {', '.join(sorted(wrong))}")
    return template


def load(folder: str | None = None) -> dict[str, str]:
    """The templates, by name; those that a folder has replace the defaults."""
    if folder is None:
        return dict(DEFAULTS)
    files = {f.stem: f for f in sorted(Path(folder).glob("*.txt"))}
    if not Path(folder).is_dir() or set(files) - set(FIELDS):
        raise UserError(f"{folder}: templates are files {', '.join(f'{n}.txt' for n in FIELDS)}")
    return DEFAULTS | {n: checked(n, f.read_text(encoding="utf-8")) for n, f in files.items()}
