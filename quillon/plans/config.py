"""Configuration: one table of keys, each with its kind, default and allowed values; everything else follows from it.

A configuration is a stack of layers, each a flat mapping of dotted names: defaults, files, experiments, changes, the
environment. The uppermost layer that has a key gives its value; all values are then held against the table.
"""

from __future__ import annotations

import os
import re
from collections import ChainMap
from collections.abc import Iterator, Mapping
from pathlib import Path
from types import MappingProxyType
from typing import NamedTuple

from ..errors import UserError
from ..operators import models

MODES = {"nenhum": "none", "bm25": "lexical", "denso": "dense", "hibrido": "hybrid"}
READERS = ("base", "ajustado")
EXPERIMENTS = {"S0": {"retriever": "nenhum"}, "S1": {"retriever": "bm25"}, "S2": {"retriever": "denso"}, "S3": {"retriever": "hibrido"}}


class Kind(NamedTuple):
    """What a value may be in a file, what it becomes, and how that is named in messages."""

    name: str
    types: tuple[type, ...]
    make: object = None


TEXT, WORDS, PLACE = Kind("a text", (str,)), Kind("a text that isn't blank", (str,)), Kind("a path", (str,))
PATTERN, ADDRESS = Kind("a regular expression", (str,)), Kind("a server's address", (str,), models.address)
FLAG, WHOLE, NUMBER = Kind("true or false", (bool,)), Kind("a whole number", (int,)), Kind("a number", (int, float), float)
MAYBE, LIST = Kind("a number or nothing", (int, float, type(None)), lambda x: None if x is None else float(x)), Kind("a list of texts", (list, tuple), tuple)

# The keys of a configuration with their kinds, default values and allowed values (an interval, or a choice),
# as users' files have them.
KEYS: dict[str, tuple] = {
    "paths.manual_pdf": (PLACE, "data/manual.pdf"),
    "paths.trechos": (PLACE, "data/trechos.jsonl"),
    "paths.index_dir": (PLACE, "index"),
    "paths.runs_dir": (PLACE, "runs"),
    "paths.gold_dev": (PLACE, "data/gold_dev.jsonl"),
    "paths.gold_test": (PLACE, "data/gold_test.jsonl"),
    "paths.ppl_holdout": (PLACE, "data/ppl_holdout.txt"),
    "ollama.host": (ADDRESS, "http://localhost:11434"),
    "ollama.timeout_s": (NUMBER, 300.0),
    "modelos.leitor_base": (TEXT, "qwen3:4b"),
    "modelos.leitor_ajustado": (TEXT, "qwen3:4b-ajustado"),
    "modelos.embeddings": (TEXT, "bge-m3"),
    "modelos.gerador": (TEXT, "llama3.2:3b"),
    "ingestao.remover_cabecalhos_rodapes": (FLAG, True),
    "ingestao.limiar_repeticao_cabecalho": (NUMBER, 0.5, "(0, 1]"),
    "ingestao.regex_titulo": (PATTERN, r"^(\d+(\.\d+){0,3})\s+[A-ZÁÉÍÓÚÂÊÔÃÕÇ][^\n]{2,80}$"),
    "ingestao.validar_sequencia_titulos": (FLAG, True),
    "ingestao.min_chars_paragrafo": (WHOLE, 25),
    "trechos.max_tokens": (WHOLE, 400, "[1, inf)"),
    "trechos.min_tokens": (WHOLE, 60, "[0, inf)"),
    "trechos.tokens_por_palavra": (NUMBER, 1.3, "(0, inf)"),
    "trechos.sobreposicao_paragrafos": (WHOLE, 0, "[0, inf)"),
    "bm25.k1": (NUMBER, 1.5),
    "bm25.b": (NUMBER, 0.75),
    "bm25.remover_stopwords": (FLAG, True),
    "bm25.manter_acentos": (FLAG, True),
    "denso.dimensao": (WHOLE, 1024, "[1, inf)"),
    "denso.normalizar_l2": (FLAG, True),
    "denso.batch_size": (WHOLE, 16, "[1, inf)"),
    "retriever": (TEXT, "hibrido", tuple(MODES)),
    "k": (WHOLE, 5, "[1, inf)"),
    "k_candidatos_por_lista": (WHOLE, 20),
    "rrf_c": (WHOLE, 60, "[0, inf)"),
    "decodificacao.temperature": (NUMBER, 0.0),
    "decodificacao.top_p": (NUMBER, 1.0),
    "decodificacao.seed": (WHOLE, 42),
    "decodificacao.num_ctx": (WHOLE, 8192),
    "decodificacao.num_predict": (WHOLE, 200),
    "decodificacao.think": (FLAG, False),
    "abstencao.frase": (WORDS, "Não encontrado no manual"),
    "abstencao.limiar_score": (MAYBE, None),
    "gold.n_candidatas": (WHOLE, 150, "[1, inf)"),
    "gold.frac_sem_resposta": (NUMBER, 0.2, "[0, 1)"),
    "gold.frac_dev": (NUMBER, 0.3, "(0, 1)"),
    "gold.seed": (WHOLE, 42),
    "avaliacao.configs": (LIST, ("S0", "S1", "S2", "S3")),
    "avaliacao.leitores": (LIST, ("base", "ajustado"), READERS),
    "avaliacao.repeticoes": (WHOLE, 1, "[1, inf)"),
    "avaliacao.bertscore_modelo": (TEXT, "neuralmind/bert-base-portuguese-cased"),
    "avaliacao.bertscore_num_layers": (WHOLE, 9),
    "avaliacao.ppl_ctx": (WHOLE, 2048),
}
# Keys of which the first must not be above the second.
ORDERED = [("trechos.min_tokens", "trechos.max_tokens"), ("k", "k_candidatos_por_lista")]
SECTIONS = {name.rpartition(".")[0] for name in KEYS} - {""}


def within(interval: str, x: float) -> bool:
    """Whether a number lies in an interval like "(0, 1]"."""
    low, high = (float(end) for end in interval[1:-1].split(","))
    return (low < x or low == x and interval[0] == "[") and (x < high or x == high and interval[-1] == "]")


def is_pattern(text: str) -> bool:
    try:
        return bool(re.compile(text)) or True
    except re.error:
        return False


def flat(tree: Mapping, above: str = "") -> Iterator[tuple[str, object]]:
    """Dotted names and values of nested mappings. An empty section has none."""
    for key, value in tree.items():
        name = f"{above}{key}"
        if isinstance(value, Mapping) and (value or name in SECTIONS):
            yield from flat(value, f"{name}.")
        else:
            yield name, value


def judged(name: str, value) -> tuple[object, str | None]:
    """The value as it is used, or what it must be."""
    kind, _, *allowed = KEYS[name]
    fits = isinstance(value, kind.types) and (not isinstance(value, bool) or bool in kind.types)
    fits = fits and not (kind is LIST and not all(isinstance(x, str) for x in value))
    fits = fits and not (kind is PLACE and not value or kind is WORDS and not value.strip() or kind is PATTERN and not is_pattern(value))
    if not fits:
        return None, f"{name} must be {kind.name}"
    value = kind.make(value) if kind.make else value
    if allowed and isinstance(allowed[0], str) and not within(allowed[0], value):
        return None, f"{name} must be in {allowed[0]}"
    if allowed and isinstance(allowed[0], tuple) and not set(value if kind is LIST else [value]) <= set(allowed[0]):
        return None, f"{name} must be of {', '.join(allowed[0])}"
    return value, None


def nested(values: Mapping[str, object]) -> MappingProxyType:
    """Read-only mappings, one in the other, by the dots of the names."""
    out: dict = {}
    for name, value in values.items():
        section, _, key = name.rpartition(".")
        (out.setdefault(section, {}) if section else out)[key] = value
    return MappingProxyType({k: MappingProxyType(v) if k in SECTIONS else v for k, v in out.items()})


def file_layer(path: str) -> Mapping:
    import yaml

    try:
        tree = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except OSError:
        raise UserError(f"no configuration {path}; experiments: {', '.join(EXPERIMENTS)}") from None
    except yaml.YAMLError as e:
        raise UserError(f"{path} is no YAML: {e}") from None
    if not isinstance(tree or {}, Mapping):
        raise UserError(f"{path} must hold keys and values")
    return tree or {}


def layer(source: str | Mapping) -> dict[str, object]:
    """What a source says, by dotted names."""
    if isinstance(source, str):
        source = EXPERIMENTS.get(source) or file_layer(source)
    return dict(flat(source))


def load(*sources: str | dict | None, name: str | None = None) -> MappingProxyType:
    """The defaults below the sources in order: files, names of experiments (S0 to S3), or dicts; on top the environment's
    OLLAMA_HOST. Everything that is wrong is told at once. A configuration is named after its last file or experiment."""
    named = [s for s in sources if isinstance(s, str)]
    layers = [layer(s) for s in sources if s is not None]
    layers += [{"ollama.host": os.environ["OLLAMA_HOST"]}] if os.environ.get("OLLAMA_HOST") else []
    stack = ChainMap(*reversed(layers), {key: default for key, (_, default, *_) in KEYS.items()})
    wrong = [f"unknown key {key}" if key not in SECTIONS else f"{key} must be a section" for key in sorted(set(stack) - set(KEYS))]
    values = {}
    for key in KEYS:
        values[key], problem = judged(key, stack[key])
        wrong += [problem] if problem else []
    wrong += [f"{a} must not be above {b}" for a, b in ORDERED if values[a] is not None and values[b] is not None and values[a] > values[b]]
    if wrong:
        raise UserError("configuration: " + "; ".join(wrong))
    return MappingProxyType(dict(nested(values)) | {"nome": name or (Path(named[-1]).stem if named else "base")})


def plain(c) -> dict:
    """As ordinary dicts and lists, for JSON."""
    return {k: plain(v) if isinstance(v, MappingProxyType) else list(v) if isinstance(v, tuple) else v for k, v in c.items()}


def reader_model(c, reader: str) -> str:
    if reader not in READERS:
        raise UserError(f"unknown reader {reader!r}; one of {', '.join(READERS)}")
    return c["modelos"][f"leitor_{reader}"]
