"""Declared schemas of the derived tables T1-T13 (Spark DDL).

``check(df, name)`` compares a built frame with its declaration: column names,
order and types.  Builds are tested against these, so a change of type (say a
sum that drifted to decimal(28,2)) fails in the tests, not in a consumer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

_GROUPED = ("total_parcelamentos bigint, empresas_distintas bigint, qtd_ativos bigint, qtd_quitados bigint, "
            "qtd_cancelados bigint, taxa_sucesso_pct double, valor_total decimal(18,2), "
            "valor_ativos decimal(18,2), empresas_alto_risco bigint")

DDL = {
    "agreements": (
        "num_parcelamento bigint, cnpj string, cnpj_raiz string, razao_social string, cd_gerfe int, "
        "gerfe string, ges string, descricao_secao string, situacao_cadastral string, "
        "flag_simples_nacional int, categoria_parcelamento string, cd_status int, desc_status string, "
        "valor_parcelado decimal(18,2), num_parcelas int, faixa_parcelas string, dt_pedido timestamp_ntz, "
        "dt_fim timestamp_ntz, tipo_adesao string, origem_debito string"),
    "companies": (
        "cnpj_raiz string, cnpj string, razao_social string, gerfe string, ges string, "
        "situacao_cadastral string, total_parcelamentos bigint, qtd_ativos bigint, qtd_quitados bigint, "
        "qtd_cancelados bigint, qtd_pendentes_1a_parcela bigint, taxa_sucesso_pct double, "
        "valor_total_parcelado decimal(18,2), valor_ativos decimal(18,2), "
        "valor_medio_parcelamento decimal(18,2), media_parcelas double, media_dias_quitacao double, "
        "media_dias_ate_cancelamento double, dias_desde_ultimo_parcelamento int, flag_reincidente int, "
        "flag_nunca_quitou int, flag_simples_nacional int, classificacao_comportamento string"),
    "scores": (
        "cnpj_raiz string, cnpj string, razao_social string, gerfe string, total_parcelamentos bigint, "
        "qtd_ativos bigint, qtd_cancelados bigint, valor_ativos decimal(18,2), taxa_sucesso_pct double, "
        "flag_reincidente int, score_historico_cancelamento double, score_recencia double, "
        "score_valor_risco double, score_reincidencia double, score_comportamento double, "
        "score_risco_final double, classificacao_risco string"),
    "receipts": (
        "num_parcelamento bigint, cnpj_raiz string, risco_empresa string, "
        "valor_esperado_3_meses decimal(18,2), valor_esperado_12_meses decimal(18,2), "
        "valor_ajustado_risco_3_meses decimal(18,2), valor_ajustado_risco_12_meses decimal(18,2)"),
    "series": (
        "periodo_pedido date, ano_pedido int, total_parcelamentos bigint, qtd_ativos bigint, "
        "qtd_quitados bigint, qtd_cancelados bigint, qtd_icms bigint, qtd_dva bigint, qtd_declarado bigint, "
        "qtd_recuperamais bigint, valor_total decimal(18,2), valor_quitado decimal(18,2), "
        "valor_cancelado decimal(18,2), ticket_medio decimal(18,2), taxa_sucesso_pct double"),
    "region": "cd_gerfe int, gerfe string, " + _GROUPED,
    "sector": "ges string, " + _GROUPED,
    "activity": "descricao_secao string, " + _GROUPED,
    "band": "faixa_parcelas string, " + _GROUPED,
    "programme": "categoria_parcelamento string, " + _GROUPED,
    "recovery": (
        "num_parcelamento bigint, cnpj_raiz string, tipo_adesao string, origem_debito string, cd_status int, "
        "desc_status string, valor_parcelado decimal(18,2), num_parcelas int"),
    "alerts": (
        "num_parcelamento bigint, cnpj_raiz string, cnpj string, razao_social string, gerfe string, "
        "tipo_alerta string, prioridade int, desc_prioridade string, valor_parcelado decimal(18,2), "
        "dias_vida_parcelamento int, classificacao_risco string"),
    "summary": (
        "total_parcelamentos bigint, total_empresas bigint, valor_total_parcelado decimal(18,2), "
        "taxa_sucesso_global_pct double, total_alertas bigint, alertas_urgentes bigint, qtd_ativos bigint, "
        "valor_ativos decimal(18,2), qtd_quitados bigint, valor_quitados decimal(18,2), qtd_cancelados bigint, "
        "valor_cancelados decimal(18,2), qtd_pendentes_1a_parcela bigint, qtd_icms bigint, "
        "qtd_dva bigint, qtd_declarado bigint, total_recuperamais bigint, "
        "valor_icms decimal(18,2), valor_dva decimal(18,2), valor_declarado decimal(18,2), "
        "valor_recuperamais decimal(18,2), empresas_risco_critico bigint, valor_empresas_alto_risco decimal(18,2), "
        "empresas_risco_alto bigint, empresas_reincidentes bigint, empresas_nunca_quitaram bigint, "
        "expectativa_3_meses decimal(18,2), expectativa_ajustada_3_meses decimal(18,2), "
        "expectativa_12_meses decimal(18,2), expectativa_ajustada_12_meses decimal(18,2), "
        "recuperamais_ativos bigint, recuperamais_quitados bigint, taxa_sucesso_recuperamais_pct double"),
}


def declared(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])


def check(df: DataFrame, name: str) -> list[str]:
    """Differences between ``df`` and the declared schema (empty = conforms).

    Nullability is not compared."""
    want = [(f.name, f.dataType.simpleString()) for f in declared(name).fields]
    got = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    if want == got:
        return []
    out = []
    wn, gn = [w[0] for w in want], [g[0] for g in got]
    if wn != gn:
        out.append(f"columns: missing {sorted(set(wn) - set(gn))}, extra {sorted(set(gn) - set(wn))}, "
                   f"order {'same' if sorted(wn) == sorted(gn) and wn == gn else 'differs'}")
    gd = dict(got)
    out += [f"{n}: {t} != {gd[n]}" for n, t in want if n in gd and gd[n] != t]
    return out
