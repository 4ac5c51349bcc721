import math

from ridgeline.functions import stats


def test_t_two_sided_known_values():
    # t = 2.0 on 10 df: two-sided p = 0.07339 (standard tables)
    assert abs(stats.t_sf2(2.0, 10) - 0.073388) < 1e-5
    assert abs(stats.t_sf2(0.0, 5) - 1.0) < 1e-12


def test_f_and_chi2_known_values():
    # d1 = 2 has the closed form (1 + d1 f / d2)^(-d2 / 2) = 1.4^-10
    assert abs(stats.f_sf(4.0, 2, 20) - 1.4 ** -10) < 1e-12
    assert abs(stats.chi2_sf(3.841459, 1) - 0.05) < 1e-6
    assert abs(stats.chi2_sf(10.0, 4) - 0.040428) < 1e-5


def test_normal_tail():
    assert abs(stats.norm_sf(1.959964) - 0.025) < 1e-6
    assert abs(stats.norm_sf(0.0) - 0.5) < 1e-12
    assert math.isclose(stats.betainc(2, 3, 0.0), 0.0)
