"""DuckDB SQL for the correctness oracle.

The derived tables are written here a second time, directly in SQL over the
driver's raw tables (``orders``, ``lineitem``, ``customer``, ``nation``,
``region``), as common table expressions.  They follow the same OURS rules
as the Spark builds but are written the plain way (direct joins, COUNT
DISTINCT), so a mismatch points at a real bug on one side.

``with_tables(names)`` emits a WITH clause holding the requested tables and
everything they depend on, in dependency order.
"""

from __future__ import annotations

from tranche import config as C

AS_OF = f"DATE '{C.DEFAULT.as_of.isoformat()}'"
MONEY = "DECIMAL(18,2)"


def half_up_div(num: str, den: str) -> str:
    return (f"(CASE WHEN ({num}) < 0 THEN -((2 * abs({num}) + ({den})) // (2 * ({den}))) "
            f"ELSE (2 * abs({num}) + ({den})) // (2 * ({den})) END)")


def cents(x: str) -> str:
    return f"CAST(({x}) * 100 AS BIGINT)"


def from_cents(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(20,0)) * CAST(0.01 AS DECIMAL(2,2)) AS {MONEY})"


def money_avg(total: str, n: str) -> str:
    return f"(CASE WHEN ({n}) > 0 THEN {from_cents(half_up_div(cents(total), n))} END)"


def avg_round1(total: str, n: str) -> str:
    return f"(CASE WHEN ({n}) > 0 THEN CAST({half_up_div(f'CAST({total} AS BIGINT) * 10', n)} AS DOUBLE) / 10.0 END)"


def rate(part: str, whole: str) -> str:
    return f"(CASE WHEN ({whole}) > 0 THEN CAST({part} AS DOUBLE) * 100.0 / CAST({whole} AS DOUBLE) END)"


def risk_class(score: str) -> str:
    return (f"(CASE WHEN {score} >= 80 THEN 'CRÍTICO' WHEN {score} >= 60 THEN 'ALTO' "
            f"WHEN {score} >= 40 THEN 'MÉDIO' WHEN {score} IS NOT NULL THEN 'BAIXO' END)")


def brl(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN 'R$ 0,00' ELSE "
            f"'R$ ' || translate(format('{{:,.2f}}', CAST({x} AS DOUBLE)), ',.', '.,') END)")


def brl_scaled(x: str, scale: str, suffix: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN 'R$ 0,00 {suffix}' ELSE "
            f"'R$ ' || translate(format('{{:,.2f}}', CAST({x} AS DOUBLE) / {scale}), ',.', '.,') || ' {suffix}' END)")


def brl_mm(x: str) -> str:
    return brl_scaled(x, "1e6", "MM")


def brl_bi(x: str) -> str:
    return brl_scaled(x, "1e9", "Bi")


def pct(x: str) -> str:
    return f"(format('{{:.1f}}', CAST({x} AS DOUBLE)) || '%')"


def fmt_int(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def tax_id_clean(x: str) -> str:
    s = f"translate(trim(CAST({x} AS VARCHAR)), './-', '')"
    return f"(CASE WHEN length({s}) < 14 THEN lpad({s}, 14, '0') ELSE {s} END)"


def tax_id_pretty(x: str) -> str:
    s = tax_id_clean(x)
    return (f"(CASE WHEN length({s}) = 14 THEN substr({s},1,2) || '.' || substr({s},3,3) || '.' || "
            f"substr({s},6,3) || '/' || substr({s},9,4) || '-' || substr({s},13,2) ELSE CAST({x} AS VARCHAR) END)")


_STATUS_CASE = "CASE cd_status " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in C.STATUS.items()) + " END"

TABLES: dict[str, tuple[list[str], str]] = {}


def _t(name: str, deps: list[str], sql: str) -> None:
    TABLES[name] = (deps, sql)


_root = ("CASE WHEN length(CAST(o.o_custkey AS VARCHAR)) < 8 THEN lpad(CAST(o.o_custkey AS VARCHAR), 8, '0') "
         "ELSE CAST(o.o_custkey AS VARCHAR) END")

_t("agreements_src", [], f"""
SELECT o.o_orderkey AS num_parcelamento,
       {_root} AS cnpj_raiz,
       c.c_name AS razao_social,
       CAST(n.n_nationkey AS INTEGER) AS cd_gerfe,
       n.n_name AS gerfe, c.c_mktsegment AS ges, r.r_name AS descricao_secao,
       CASE WHEN c.c_acctbal < 0 THEN 'BAIXADA' ELSE 'ATIVA' END AS situacao_cadastral,
       CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END AS flag_simples_nacional,
       CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'ICMS' WHEN '2' THEN 'DÍVIDA ATIVA'
            WHEN '3' THEN 'DECLARADO' WHEN '4' THEN 'RECUPERA+' WHEN '5' THEN 'OUTROS' END AS categoria_parcelamento,
       CAST(CASE WHEN o.o_orderstatus = 'F' THEN 5 WHEN o.o_orderstatus = 'O' THEN 1
            WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 5 = 0 THEN 6
            WHEN o.o_orderstatus = 'P' THEN 2 END AS INTEGER) AS cd_status,
       CAST(o.o_totalprice AS {MONEY}) AS valor_parcelado,
       CAST(coalesce(li.n_lines, 0) AS INTEGER) AS num_parcelas,
       o.o_orderdate AS dt_pedido,
       li.last_ship,
       CASE ((o.o_orderkey % 4) + 4) % 4 WHEN 0 THEN 'DECLARADO' WHEN 1 THEN 'DEFESA PRÉVIA'
            WHEN 2 THEN 'NOTIFICAÇÃO FISCAL' WHEN 3 THEN 'DÍVIDA ATIVA' END AS origem_debito
FROM orders o
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, max(l_shipdate) AS last_ship
           FROM lineitem GROUP BY l_orderkey) li ON li.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")

_t("agreements", ["agreements_src"], f"""
SELECT num_parcelamento,
       CASE WHEN cnpj_raiz IS NOT NULL THEN cnpj_raiz || '000100' END AS cnpj,
       cnpj_raiz, razao_social, cd_gerfe, gerfe, ges, descricao_secao, situacao_cadastral,
       flag_simples_nacional, categoria_parcelamento, cd_status,
       {_STATUS_CASE} AS desc_status,
       valor_parcelado, num_parcelas,
       CASE WHEN num_parcelas = 0 THEN '0' WHEN num_parcelas = 1 THEN '1'
            WHEN num_parcelas BETWEEN 2 AND 12 THEN '2-12' WHEN num_parcelas BETWEEN 13 AND 24 THEN '13-24'
            WHEN num_parcelas BETWEEN 25 AND 60 THEN '25-60' WHEN num_parcelas BETWEEN 61 AND 120 THEN '61-120'
            WHEN num_parcelas >= 121 THEN '>120' END AS faixa_parcelas,
       dt_pedido,
       CASE WHEN cd_status IN (5, 2) AND last_ship >= dt_pedido THEN last_ship END AS dt_fim,
       CASE WHEN num_parcelas = 1 THEN 'COTA ÚNICA' ELSE 'PARCELADO' END AS tipo_adesao,
       origem_debito
FROM agreements_src""")

_days = "date_diff('day', CAST(dt_pedido AS DATE), CAST(dt_fim AS DATE))"
_t("companies_agg", ["agreements"], f"""
SELECT cnpj_raiz, max(cnpj) AS cnpj, max(razao_social) AS razao_social, max(gerfe) AS gerfe,
       max(ges) AS ges, max(situacao_cadastral) AS situacao_cadastral,
       max(flag_simples_nacional) AS fsn,
       count(*) AS total_parcelamentos,
       count(*) FILTER (WHERE cd_status = 1) AS qtd_ativos,
       count(*) FILTER (WHERE cd_status = 5) AS qtd_quitados,
       count(*) FILTER (WHERE cd_status = 2) AS qtd_cancelados,
       count(*) FILTER (WHERE cd_status = 6) AS qtd_pendentes_1a_parcela,
       sum(valor_parcelado) AS v, count(valor_parcelado) AS nv,
       sum(CASE WHEN cd_status = 1 THEN valor_parcelado END) AS va,
       sum(num_parcelas) AS sn, count(num_parcelas) AS nn,
       sum(CASE WHEN cd_status = 5 AND dt_fim IS NOT NULL THEN {_days} END) AS sq,
       count(CASE WHEN cd_status = 5 AND dt_fim IS NOT NULL THEN 1 END) AS nq,
       sum(CASE WHEN cd_status = 2 AND dt_fim IS NOT NULL THEN {_days} END) AS sc,
       count(CASE WHEN cd_status = 2 AND dt_fim IS NOT NULL THEN 1 END) AS nc,
       max(dt_pedido) AS last_req
FROM agreements WHERE cnpj_raiz IS NOT NULL GROUP BY cnpj_raiz""")

_rate_qc = rate("qtd_quitados", "qtd_quitados + qtd_cancelados")
_t("companies", ["companies_agg"], f"""
SELECT cnpj_raiz, cnpj, razao_social, gerfe, ges, situacao_cadastral,
       total_parcelamentos, qtd_ativos, qtd_quitados, qtd_cancelados, qtd_pendentes_1a_parcela,
       {_rate_qc} AS taxa_sucesso_pct,
       CAST(v AS {MONEY}) AS valor_total_parcelado,
       CAST(coalesce(va, 0) AS {MONEY}) AS valor_ativos,
       {money_avg('v', 'nv')} AS valor_medio_parcelamento,
       CASE WHEN nn > 0 THEN CAST(sn AS DOUBLE) / CAST(nn AS DOUBLE) END AS media_parcelas,
       CASE WHEN nq > 0 THEN CAST(sq AS DOUBLE) / CAST(nq AS DOUBLE) END AS media_dias_quitacao,
       CASE WHEN nc > 0 THEN CAST(sc AS DOUBLE) / CAST(nc AS DOUBLE) END AS media_dias_ate_cancelamento,
       CAST(date_diff('day', CAST(last_req AS DATE), {AS_OF}) AS INTEGER) AS dias_desde_ultimo_parcelamento,
       CASE WHEN qtd_cancelados >= 3 THEN 1 ELSE 0 END AS flag_reincidente,
       CASE WHEN qtd_quitados = 0 THEN 1 ELSE 0 END AS flag_nunca_quitou,
       CAST(fsn AS INTEGER) AS flag_simples_nacional,
       CASE WHEN qtd_cancelados >= 3 AND {_rate_qc} < 50 THEN 'ALTO RISCO'
            WHEN qtd_cancelados >= 1 AND {_rate_qc} < 70 THEN 'RISCO MODERADO'
            WHEN {_rate_qc} >= 70 THEN 'BOM PAGADOR'
            ELSE 'SEM HISTÓRICO' END AS classificacao_comportamento
FROM companies_agg""")

_t("scores_parts", ["companies"], f"""
SELECT cnpj_raiz, cnpj, razao_social, gerfe, total_parcelamentos, qtd_ativos, qtd_cancelados,
       valor_ativos, taxa_sucesso_pct, flag_reincidente,
       coalesce({rate('qtd_cancelados', 'qtd_quitados + qtd_cancelados')}, 0.0) AS score_historico_cancelamento,
       CASE WHEN dias_desde_ultimo_parcelamento <= 90 THEN 100.0
            WHEN dias_desde_ultimo_parcelamento <= 180 THEN 75.0
            WHEN dias_desde_ultimo_parcelamento <= 365 THEN 50.0
            WHEN dias_desde_ultimo_parcelamento <= 720 THEN 25.0 ELSE 0.0 END AS score_recencia,
       CASE WHEN valor_ativos >= 1000000 THEN 100.0 WHEN valor_ativos >= 500000 THEN 75.0
            WHEN valor_ativos >= 100000 THEN 50.0 WHEN valor_ativos > 0 THEN 25.0 ELSE 0.0 END AS score_valor_risco,
       CASE WHEN flag_reincidente = 1 THEN 100.0 ELSE 0.0 END AS score_reincidencia,
       CASE classificacao_comportamento WHEN 'ALTO RISCO' THEN 100.0 WHEN 'RISCO MODERADO' THEN 60.0
            WHEN 'BOM PAGADOR' THEN 20.0 ELSE 40.0 END AS score_comportamento
FROM companies""")

_t("scores", ["scores_parts"], f"""
SELECT *, {risk_class('score_risco_final')} AS classificacao_risco FROM (
  SELECT cnpj_raiz, cnpj, razao_social, gerfe, total_parcelamentos, qtd_ativos, qtd_cancelados,
         valor_ativos, taxa_sucesso_pct, flag_reincidente,
         CAST(score_historico_cancelamento AS DOUBLE) AS score_historico_cancelamento,
         CAST(score_recencia AS DOUBLE) AS score_recencia,
         CAST(score_valor_risco AS DOUBLE) AS score_valor_risco,
         CAST(score_reincidencia AS DOUBLE) AS score_reincidencia,
         CAST(score_comportamento AS DOUBLE) AS score_comportamento,
         CAST(0.30 AS DOUBLE) * CAST(score_historico_cancelamento AS DOUBLE)
         + CAST(0.20 AS DOUBLE) * CAST(score_recencia AS DOUBLE)
         + CAST(0.25 AS DOUBLE) * CAST(score_valor_risco AS DOUBLE)
         + CAST(0.15 AS DOUBLE) * CAST(score_reincidencia AS DOUBLE)
         + CAST(0.10 AS DOUBLE) * CAST(score_comportamento AS DOUBLE) AS score_risco_final
  FROM scores_parts) t""")

_elapsed = (f"((year({AS_OF}) - year(dt_pedido)) * 12 + (month({AS_OF}) - month(dt_pedido)) "
            f"- CASE WHEN day({AS_OF}) < day(dt_pedido) THEN 1 ELSE 0 END)")
_t("receipts_base", ["agreements"], f"""
SELECT num_parcelamento, cnpj_raiz,
       greatest(num_parcelas - greatest({_elapsed}, 0), 0) AS remaining,
       CASE WHEN num_parcelas > 0 THEN {half_up_div(cents('valor_parcelado'), 'CAST(num_parcelas AS BIGINT)')}
            ELSE CAST(0 AS BIGINT) END AS inst
FROM agreements WHERE cd_status = 1 AND CAST(dt_pedido AS DATE) <= {AS_OF}""")

_prob = ("CASE s.classificacao_risco WHEN 'BAIXO' THEN CAST(0.85 AS DECIMAL(3,2)) "
         "WHEN 'MÉDIO' THEN CAST(0.65 AS DECIMAL(3,2)) WHEN 'ALTO' THEN CAST(0.40 AS DECIMAL(3,2)) "
         "WHEN 'CRÍTICO' THEN CAST(0.20 AS DECIMAL(3,2)) END")
_t("receipts", ["receipts_base", "scores"], f"""
SELECT num_parcelamento, cnpj_raiz, risco_empresa, valor_esperado_3_meses, valor_esperado_12_meses,
       CAST(valor_esperado_3_meses * prob AS {MONEY}) AS valor_ajustado_risco_3_meses,
       CAST(valor_esperado_12_meses * prob AS {MONEY}) AS valor_ajustado_risco_12_meses
FROM (SELECT b.num_parcelamento, b.cnpj_raiz, s.classificacao_risco AS risco_empresa, {_prob} AS prob,
             {from_cents('b.inst * least(3, b.remaining)')} AS valor_esperado_3_meses,
             {from_cents('b.inst * least(12, b.remaining)')} AS valor_esperado_12_meses
      FROM receipts_base b LEFT JOIN scores s ON s.cnpj_raiz = b.cnpj_raiz) t""")

_t("series", ["agreements"], f"""
SELECT periodo_pedido, CAST(year(periodo_pedido) AS INTEGER) AS ano_pedido,
       total_parcelamentos, qtd_ativos, qtd_quitados, qtd_cancelados,
       qtd_icms, qtd_dva, qtd_declarado, qtd_recuperamais,
       CAST(coalesce(v, 0) AS {MONEY}) AS valor_total,
       CAST(coalesce(vq, 0) AS {MONEY}) AS valor_quitado,
       CAST(coalesce(vc, 0) AS {MONEY}) AS valor_cancelado,
       {money_avg('v', 'nv')} AS ticket_medio,
       {_rate_qc} AS taxa_sucesso_pct
FROM (SELECT CAST(date_trunc('month', dt_pedido) AS DATE) AS periodo_pedido,
             count(*) AS total_parcelamentos,
             count(*) FILTER (WHERE cd_status = 1) AS qtd_ativos,
             count(*) FILTER (WHERE cd_status = 5) AS qtd_quitados,
             count(*) FILTER (WHERE cd_status = 2) AS qtd_cancelados,
             count(*) FILTER (WHERE categoria_parcelamento = 'ICMS') AS qtd_icms,
             count(*) FILTER (WHERE categoria_parcelamento = 'DÍVIDA ATIVA') AS qtd_dva,
             count(*) FILTER (WHERE categoria_parcelamento = 'DECLARADO') AS qtd_declarado,
             count(*) FILTER (WHERE categoria_parcelamento = 'RECUPERA+') AS qtd_recuperamais,
             sum(valor_parcelado) AS v, count(valor_parcelado) AS nv,
             sum(CASE WHEN cd_status = 5 THEN valor_parcelado END) AS vq,
             sum(CASE WHEN cd_status = 2 THEN valor_parcelado END) AS vc
      FROM agreements WHERE dt_pedido IS NOT NULL GROUP BY 1) t""")


def _grouped(keys: str, where: str = "") -> str:
    return f"""
SELECT {keys}, total_parcelamentos, empresas_distintas, qtd_ativos, qtd_quitados, qtd_cancelados,
       {_rate_qc} AS taxa_sucesso_pct,
       CAST(coalesce(v, 0) AS {MONEY}) AS valor_total,
       CAST(coalesce(va, 0) AS {MONEY}) AS valor_ativos,
       empresas_alto_risco
FROM (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))},
             count(*) AS total_parcelamentos,
             count(DISTINCT a.cnpj_raiz) AS empresas_distintas,
             count(*) FILTER (WHERE a.cd_status = 1) AS qtd_ativos,
             count(*) FILTER (WHERE a.cd_status = 5) AS qtd_quitados,
             count(*) FILTER (WHERE a.cd_status = 2) AS qtd_cancelados,
             sum(a.valor_parcelado) AS v,
             sum(CASE WHEN a.cd_status = 1 THEN a.valor_parcelado END) AS va,
             count(DISTINCT CASE WHEN s.score_risco_final >= 60 THEN a.cnpj_raiz END) AS empresas_alto_risco
      FROM agreements a LEFT JOIN scores s ON s.cnpj_raiz = a.cnpj_raiz
      {where}
      GROUP BY {', '.join('a.' + k.strip() for k in keys.split(','))}) t"""


_t("region", ["agreements", "scores"], _grouped("cd_gerfe, gerfe"))
_t("sector", ["agreements", "scores"], _grouped("ges"))
_t("activity", ["agreements", "scores"], _grouped("descricao_secao"))
_t("band", ["agreements", "scores"], _grouped("faixa_parcelas"))
_progs = ", ".join(f"'{p}'" for p in C.DEFAULT.programme_categories)
_t("programme", ["agreements", "scores"],
   _grouped("categoria_parcelamento", f"WHERE a.categoria_parcelamento IN ({_progs})"))

_t("recovery", ["agreements"], """
SELECT num_parcelamento, cnpj_raiz, tipo_adesao, origem_debito, cd_status, desc_status,
       valor_parcelado, num_parcelas
FROM agreements WHERE categoria_parcelamento = 'RECUPERA+'""")

_t("alerts", ["agreements", "scores"], f"""
SELECT num_parcelamento, cnpj_raiz, cnpj, razao_social, gerfe, tipo_alerta, prioridade,
       CASE prioridade WHEN 1 THEN 'URGENTE' WHEN 2 THEN 'ALTA' WHEN 3 THEN 'MÉDIA' WHEN 4 THEN 'BAIXA' END AS desc_prioridade,
       valor_parcelado, dias_vida_parcelamento, classificacao_risco
FROM (SELECT a.num_parcelamento, a.cnpj_raiz, a.cnpj, a.razao_social, a.gerfe,
             CASE WHEN s.flag_reincidente = 1 THEN 'REINCIDÊNCIA'
                  WHEN a.valor_parcelado >= CAST({C.DEFAULT.alert_high_value} AS {MONEY}) THEN 'VALOR ELEVADO'
                  WHEN s.score_risco_final >= 60 THEN 'RISCO CANCELAMENTO'
                  WHEN a.cd_status = 6 AND date_diff('day', CAST(a.dt_pedido AS DATE), {AS_OF}) > 90 THEN 'ATRASO PAGAMENTO'
             END AS tipo_alerta,
             CASE WHEN s.score_risco_final >= 80 THEN 1 WHEN s.score_risco_final >= 60 THEN 2
                  WHEN s.score_risco_final >= 40 THEN 3 ELSE 4 END AS prioridade,
             a.valor_parcelado,
             CAST(date_diff('day', CAST(a.dt_pedido AS DATE), {AS_OF}) AS INTEGER) AS dias_vida_parcelamento,
             s.classificacao_risco
      FROM agreements a LEFT JOIN scores s ON s.cnpj_raiz = a.cnpj_raiz
      WHERE a.cd_status IN (1, 6)) t
WHERE tipo_alerta IS NOT NULL""")


def _msum(x: str) -> str:
    return f"CAST(coalesce(sum({x}), 0) AS {MONEY})"


_t("summary", ["agreements", "companies", "scores", "receipts", "recovery", "alerts"], f"""
SELECT t1.total_parcelamentos, t2.total_empresas, t1.valor_total_parcelado,
       {rate('t1.qtd_quitados', 't1.qtd_quitados + t1.qtd_cancelados')} AS taxa_sucesso_global_pct,
       t12.total_alertas, t12.alertas_urgentes,
       t1.qtd_ativos, t1.valor_ativos, t1.qtd_quitados, t1.valor_quitados, t1.qtd_cancelados,
       t1.valor_cancelados, t1.qtd_pendentes_1a_parcela, t1.qtd_icms, t1.qtd_dva,
       t1.qtd_declarado, t11.total_recuperamais, t1.valor_icms, t1.valor_dva,
       t1.valor_declarado, t11.valor_recuperamais,
       t3.empresas_risco_critico, t3.valor_empresas_alto_risco, t3.empresas_risco_alto,
       t2.empresas_reincidentes, t2.empresas_nunca_quitaram,
       t4.expectativa_3_meses, t4.expectativa_ajustada_3_meses, t4.expectativa_12_meses,
       t4.expectativa_ajustada_12_meses,
       t11.recuperamais_ativos, t11.recuperamais_quitados,
       {rate('t11.recuperamais_quitados', 't11.recuperamais_quitados + t11.rc')} AS taxa_sucesso_recuperamais_pct
FROM (SELECT count(*) AS total_parcelamentos, {_msum('valor_parcelado')} AS valor_total_parcelado,
             count(*) FILTER (WHERE cd_status = 1) AS qtd_ativos,
             {_msum('CASE WHEN cd_status = 1 THEN valor_parcelado END')} AS valor_ativos,
             count(*) FILTER (WHERE cd_status = 5) AS qtd_quitados,
             {_msum('CASE WHEN cd_status = 5 THEN valor_parcelado END')} AS valor_quitados,
             count(*) FILTER (WHERE cd_status = 2) AS qtd_cancelados,
             {_msum('CASE WHEN cd_status = 2 THEN valor_parcelado END')} AS valor_cancelados,
             count(*) FILTER (WHERE cd_status = 6) AS qtd_pendentes_1a_parcela,
             count(*) FILTER (WHERE categoria_parcelamento = 'ICMS') AS qtd_icms,
             count(*) FILTER (WHERE categoria_parcelamento = 'DÍVIDA ATIVA') AS qtd_dva,
             count(*) FILTER (WHERE categoria_parcelamento = 'DECLARADO') AS qtd_declarado,
             {_msum("CASE WHEN categoria_parcelamento = 'ICMS' THEN valor_parcelado END")} AS valor_icms,
             {_msum("CASE WHEN categoria_parcelamento = 'DÍVIDA ATIVA' THEN valor_parcelado END")} AS valor_dva,
             {_msum("CASE WHEN categoria_parcelamento = 'DECLARADO' THEN valor_parcelado END")} AS valor_declarado
      FROM agreements) t1,
     (SELECT count(*) AS total_empresas,
             count(*) FILTER (WHERE flag_reincidente = 1) AS empresas_reincidentes,
             count(*) FILTER (WHERE flag_nunca_quitou = 1) AS empresas_nunca_quitaram FROM companies) t2,
     (SELECT count(*) FILTER (WHERE classificacao_risco = 'CRÍTICO') AS empresas_risco_critico,
             {_msum('CASE WHEN score_risco_final >= 60 THEN valor_ativos END')} AS valor_empresas_alto_risco,
             count(*) FILTER (WHERE classificacao_risco = 'ALTO') AS empresas_risco_alto FROM scores) t3,
     (SELECT {_msum('valor_esperado_3_meses')} AS expectativa_3_meses,
             {_msum('valor_ajustado_risco_3_meses')} AS expectativa_ajustada_3_meses,
             {_msum('valor_esperado_12_meses')} AS expectativa_12_meses,
             {_msum('valor_ajustado_risco_12_meses')} AS expectativa_ajustada_12_meses FROM receipts) t4,
     (SELECT count(*) AS total_recuperamais, {_msum('valor_parcelado')} AS valor_recuperamais,
             count(*) FILTER (WHERE cd_status = 1) AS recuperamais_ativos,
             count(*) FILTER (WHERE cd_status = 5) AS recuperamais_quitados,
             count(*) FILTER (WHERE cd_status = 2) AS rc FROM recovery) t11,
     (SELECT count(*) AS total_alertas, count(*) FILTER (WHERE prioridade = 1) AS alertas_urgentes
      FROM alerts) t12""")

_t("ml_frame", ["companies"], """
SELECT cnpj_raiz, total_parcelamentos, qtd_ativos, qtd_cancelados, qtd_quitados,
       qtd_pendentes_1a_parcela, taxa_sucesso_pct, valor_total_parcelado, valor_medio_parcelamento,
       media_parcelas, media_dias_quitacao, media_dias_ate_cancelamento,
       dias_desde_ultimo_parcelamento, flag_reincidente, flag_nunca_quitou, flag_simples_nacional,
       classificacao_comportamento,
       CASE WHEN qtd_ativos > 0 AND classificacao_comportamento IN ('ALTO RISCO', 'RISCO MODERADO')
            THEN 1 ELSE 0 END AS risco_cancelamento
FROM companies WHERE total_parcelamentos >= 2""")


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in TABLES[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_tables(*names: str) -> str:
    parts = [f"{n} AS ({TABLES[n][1].strip()})" for n in _closure(list(names))]
    return "WITH " + ",\n".join(parts) + "\n"
