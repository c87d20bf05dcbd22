"""Hand-made agreements (FIXTURES.md §3): one company per behaviour."""

import datetime as dt
from decimal import Decimal

from tranche.config import STATUS

AS_OF = dt.date(2024, 6, 30)

T1_SCHEMA = ("num_parcelamento bigint, cnpj string, cnpj_raiz string, razao_social string, cd_gerfe int, "
             "gerfe string, ges string, descricao_secao string, situacao_cadastral string, "
             "flag_simples_nacional int, categoria_parcelamento string, cd_status int, desc_status string, "
             "valor_parcelado decimal(18,2), num_parcelas int, faixa_parcelas string, dt_pedido timestamp_ntz, "
             "dt_fim timestamp_ntz, tipo_adesao string, origem_debito string")


def _row(num, root, status, value, n, date, cat="ICMS", region=1, band=None, end=None):
    ts = dt.datetime.combine(date, dt.time()) if date else None
    return (num, (root + "000100") if root else None, root, f"EMPRESA {root}", region, f"R{region}", "G1", "S1",
            "ATIVA", 0, cat, status, STATUS[status], Decimal(value) if value is not None else None, n,
            band, ts, end, "COTA ÚNICA" if n == 1 else "PARCELADO", "DECLARADO")


def rows():
    d = dt.date
    out = [
        _row(1, "00000001", 5, "1000.00", 1, d(2023, 1, 10), end=dt.datetime(2023, 2, 10)),
        _row(2, "00000001", 5, "3000.00", 12, d(2023, 5, 31), cat="RECUPERA+", end=dt.datetime(2024, 5, 31)),
    ]
    out += [_row(k, "00000002", 2, "5000.00", 24, d(2022, 2, 28), cat="RECUPERA+",
                 end=dt.datetime(2022, 8, 28)) for k in (3, 4, 5)]
    out += [
        _row(6, "00000002", 1, "1200000.00", 12, d(2024, 5, 31)),
        _row(7, "00000003", 1, "120.00", 12, d(2024, 6, 30), region=2),
        _row(8, "00000004", 6, "700.00", 0, d(2024, 1, 1), region=2),
        _row(9, "00000004", 2, None, 6, None, region=2),
        _row(10, None, 1, "50.00", 2, d(2024, 6, 1), region=2),
    ]
    return out


def agreements(spark):
    return spark.createDataFrame(rows(), T1_SCHEMA)
