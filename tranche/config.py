"""Parameters and fixed vocabularies.

All thresholds the derived-table builds depend on live in ``Params`` so a
run can change them without touching the operators.  The vocabularies below
are fixed values of the domain (status codes, categories, risk classes); the
outputs must use exactly these labels.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (domain vocabularies, stated as text in natural order).
# ---------------------------------------------------------------------------

# Agreement status codes and labels.
STATUS = {
    1: "ATIVO",
    2: "CANCELADO",
    3: "SUSPENSO",
    4: "PENDENTE AUTORIZAÇÃO",
    5: "QUITADO",
    6: "PENDENTE 1ª PARCELA",
    7: "EXCLUÍDO PAGTOS LIBERADOS",
    8: "SALDO TRANSFERIDO",
}
ST_ACTIVE, ST_CANCELLED, ST_SETTLED, ST_PENDING = 1, 2, 5, 6

# Agreement categories.
CATEGORIES = ["ICMS", "DÍVIDA ATIVA", "DECLARADO", "RECUPERA+", "IPVA", "ITCMD", "OUTROS"]
CAT_ICMS, CAT_DVA, CAT_DECLARED, CAT_RECOVERY = "ICMS", "DÍVIDA ATIVA", "DECLARADO", "RECUPERA+"

# Risk classes by final score: CRÍTICO >= 80, ALTO >= 60, MÉDIO >= 40, else BAIXO.
RISK_CLASSES = [("CRÍTICO", 80.0), ("ALTO", 60.0), ("MÉDIO", 40.0), ("BAIXO", None)]

# Probability that an active agreement keeps paying, by company risk class.
SUCCESS_PROBABILITY = {"BAIXO": "0.85", "MÉDIO": "0.65", "ALTO": "0.40", "CRÍTICO": "0.20"}

# Score component weights (cancellation history, recency, value at risk,
# recidivism, behaviour).
SCORE_WEIGHTS = {"historico": 0.30, "recencia": 0.20, "valor": 0.25,
                 "reincidencia": 0.15, "comportamento": 0.10}

# Behaviour classes and their behaviour-component score.
BEHAVIOUR_SCORE = {"ALTO RISCO": 100.0, "RISCO MODERADO": 60.0,
                   "BOM PAGADOR": 20.0, "SEM HISTÓRICO": 40.0}
RISKY_BEHAVIOURS = ["ALTO RISCO", "RISCO MODERADO"]

# Alert priorities (code, label).
PRIORITIES = {1: "URGENTE", 2: "ALTA", 3: "MÉDIA", 4: "BAIXA"}

# Alert types, in precedence order.
ALERT_TYPES = ["REINCIDÊNCIA", "VALOR ELEVADO", "RISCO CANCELAMENTO", "ATRASO PAGAMENTO"]

# Recovery-programme join types and debt origins.
JOIN_SINGLE, JOIN_INSTALMENTS = "COTA ÚNICA", "PARCELADO"
DEBT_ORIGINS = ["DECLARADO", "DEFESA PRÉVIA", "NOTIFICAÇÃO FISCAL", "DÍVIDA ATIVA"]

# Instalment-count bands (label, low, high inclusive; None = open).
INSTALMENT_BANDS = [("0", 0, 0), ("1", 1, 1), ("2-12", 2, 12), ("13-24", 13, 24),
                    ("25-60", 25, 60), ("61-120", 61, 120), (">120", 121, None)]

# ML features (order matters for importances) and label column.
ML_FEATURES = [
    "total_parcelamentos", "qtd_cancelados", "qtd_quitados",
    "taxa_sucesso_pct", "valor_medio_parcelamento", "media_parcelas",
    "dias_desde_ultimo_parcelamento", "flag_reincidente",
    "flag_nunca_quitou", "flag_simples_nacional",
]
ML_LABEL = "risco_cancelamento"


@dataclass(frozen=True)
class SkewParams:
    """Hot-key handling for joins keyed by company.

    A key with at least ``rows_per_bucket`` rows is hot; a table of n rows has
    at most n / rows_per_bucket of them, listed in a stored table.  A hot key is spread over ``ceil(rows / rows_per_bucket)`` buckets.
    Rows with a null key, which match nothing, are spread by their row id.
    """

    rows_per_bucket: int = 2_000_000
    # False: plain shuffle join, hot partitions left to AQE skew-join splitting
    enabled: bool = True


@dataclass(frozen=True)
class Params:
    """Run parameters for the derived-table builds (all OURS rules)."""

    as_of: _dt.date = _dt.date(2001, 8, 1)
    # success-rate cuts for behaviour classes
    behaviour_bad_rate: float = 50.0
    behaviour_good_rate: float = 70.0
    recidivist_cancellations: int = 3
    # company with score >= this is "high risk"
    high_risk_score: float = 60.0
    # alert rules
    alert_high_value: str = "450000.00"
    alert_late_days: int = 90
    # recovery programme window on dt_pedido (inclusive); None = no bound
    recovery_start: _dt.date | None = None
    recovery_end: _dt.date | None = None
    # categories treated as special programmes
    programme_categories: tuple[str, ...] = (CAT_RECOVERY,)
    # only agreements requested up to as_of enter the receipts projection
    skew: SkewParams = field(default_factory=SkewParams)


DEFAULT = Params()
