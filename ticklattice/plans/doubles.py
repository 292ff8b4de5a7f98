"""Columns of doubles in the registered results that SQL checks; generated from the queries' schemas."""

DOUBLES: dict[str, str] = {
    "a1_ohlcv_1d": "open high low close avg_price price_stddev value_traded vwap change_pct range range_pct",
    "a1_ohlcv_timeframes": "open high low close avg_price price_stddev value_traded vwap change_pct range range_pct",
    "a2_ohlcv_seconds": "open high low close",
    "a3_quote_metrics": "bid_avg bid_max bid_min ask_avg ask_max ask_min bid_last ask_last spread_bps_avg spread_bps_max spread_bps_min spread_bps_stddev mid_avg mid_stddev tight_spread_pct",
    "a4_trade_metrics": "avg_size size_stddev dollar_volume avg_price price_stddev median_size p90_size median_price vwap trades_per_second",
    "a5_market_statistics": "avg_quality avg_latency_s high_quality_pct",
    "a6_rollup_1d": "open high low close vwap",
    "a6_rollup_week": "open high low close vwap",
    "st3_sliding_windows": "avg_price",
    "sl1_keep_latest": "price",
    "dc1_dc3_fills": "centred forward backward",
    "dc2_linear_fill": "price_linear",
    "dc4_j1_statistic_fill": "price_median price_mean",
    "dc5_outliers_iqr": "capped nulled smoothed",
    "dc6_outliers_z": "capped",
    "dc8_dc9_repair_ticks": "price_fixed",
    "dc8_repair_bars": "open high low close",
    "dc10_dc11_clean_ticks": "price",
    "dv1_dv2_validate_quotes": "validation_score",
    "dv1_dv2_validate_trades": "validation_score",
    "dv3_validate_bars": "validation_score",
    "a14_validation_summary": "pass_rate",
    "a15_quality_statistics": "mean_errors mean_warnings",
    "sc8_order_book": "best_bid best_ask spread",
    "a18_dq1_completeness": "completeness",
    "a19_dq5_uniqueness": "uniqueness",
    "dq2_dq3_dq4_dq6_assess": "completeness accuracy consistency timeliness late_pct uniqueness overall",
    "fv2_custom_rules": "pass_rate",
    "dv6_conform": "price",
    "mv1_bar_report": "close_variance",
    "ad1_ad4_detectors": "anomaly_score_zscore anomaly_score_iqr anomaly_score_spike anomaly_score_volume anomaly_score_pattern",
    "ad7_ad8_classified": "composite_score max_score",
    "ad6_correlation_breaks": "market_corr corr_z",
    "ad9_matrix_scores": "z_score modified_z iqr_score",
    "ad11_seasonal_residuals": "close trend seasonal residual",
    "ad12_ad15_combine": "mean_vote weighted_vote part_is_zscore part_is_iqr part_is_spike",
    "fs1_long_features": "value",
    "j3_fs2_feature_matrix": "rsi_5 sma_5 volume",
    "sl2_latest_features": "value",
    "j4_as_of_join": "close",
    "j5_staleness_bounded": "close",
    "j4_bitemporal": "value",
    "snk5_upsert": "close",
    "snk5_insert_absent": "close",
    "snk6_delete_where": "value",
    "j12_currency": "price price_base",
    "dr1_dr4_distances": "ks wasserstein wasserstein_norm",
    "dr2_dr3_binned_tests": "psi chi_square js_distance",
    "fv1_feature_checks": "completeness variance outlier_ratio distinct_ratio least most",
    "a11_feature_statistics": "mean std least median most",
    "ml3_confusion": "accuracy precision recall f1 specificity npv fpr fnr",
    "ml3_labels_confusion": "accuracy precision recall f1 specificity npv fpr fnr",
    "ml4_ranking": "roc_auc average_precision",
    "ml5_thresholds": "threshold precision recall f1",
    "ml5_best_threshold": "f1 threshold precision recall",
    "sl7_precision_at_k": "precision_at_k",
    "j8_coverage": "coverage",
    "ml6_rolling_metrics": "precision recall",
    "ml8_mcnemar": "chi_square p_value",
    "ml8_wilcoxon": "w_plus w_minus z p_value",
    "ml8_mann_whitney": "u z p_value",
    "ml8_paired_t": "mean_difference t",
    "ml2_scaling": "standard minmax robust",
    "a20_correlation_matrix": "corr",
    "a21_variance": "variance",
    "a22_histogram": "mean std",
    "a12_metric_summary": "min max mean median std latest p95 p99",
    "ml9_backtest": "precision recall f1",
    "pr6_dividend_income": "income yield_pct",
    "pf15_alert_list": "price",
    "pr5_positions": "shares avg_cost",
    "pr1_j6_valued_positions": "shares avg_cost market_value cost_basis gain gain_pct weight",
    "a10_pr3_summary": "total_value total_cost largest_weight herfindahl gain gain_pct",
    "a9_allocation": "value percentage",
    "pr4_rebalance": "current target value cost",
    "pr2_risk": "annual_return annual_volatility sharpe sortino max_drawdown var_95",
    "pr3_benchmark": "beta correlation tracking_error active_return information_ratio",
    "pr5_tax_lots": "left cost",
    "st11_alerts": "price",
    "a8_sector_performance": "mean_change_pct volume",
    "a13_alert_statistics": "mean_price",
    "a16_source_counters": "success_rate",
    "a17_log_rates": "rate error_ratio p95",
    "st12_threshold_alerts": "value",
    "st14_alert_lifecycle": "resolution_minutes",
    "sl3_top_movers": "change_pct",
    "sl4_market_overview": "close prior change change_pct",
    "sl8_rank_models": "f1",
    "pf1_pf4_bronze": "quality_score",
    "pf5_pf12_silver": "price overall_score",
    "pf7_quote_fields": "mid spread spread_bps",
    "pf8_bar_fields": "range change change_pct",
    "src7_aliases": "price",
    "src10_array_payload": "open high low close",
    "src10_map_payload": "open close",
    "src11_tick_payload": "price",
    "src12_interval_scan": "price",
    "src13_envelope_round_trip": "price",
    "so2_tagged_union": "mean_spread",
    "sc3_sc5_sc6_scalars": "root log1 e r1 clipped",
    "sc11_null_logic": "filled",
    "ln2_impact": "impact",
    "ti1_sma": "sma_5 sma_10 sma_20 sma_50 sma_100 sma_200 sma_20_full",
    "ti2_ema": "ema_12 ema_26",
    "ti2_ema_recursive": "ema_12",
    "ti3_wma": "wma_20",
    "ti4_rsi": "rsi_ml rsi_etl rsi_dash",
    "ti5_macd": "macd macd_signal macd_hist",
    "ti6_bollinger": "bb_upper bb_middle bb_lower bb_width bb_position",
    "ti6_bollinger_population": "bb_upper bb_middle bb_lower bb_width bb_position",
    "ti7_stochastic": "stoch_k stoch_d",
    "ti8_atr": "tr atr_14",
    "ti9_adx": "plus_di minus_di adx",
    "ti10_cci": "cci_20",
    "ti11_williams_r": "williams_r",
    "ti12_momentum_roc": "momentum_10 roc_10",
    "ti13_ti14_ti20_ti21_cumulative": "pvt ad_line vwap_cum",
    "ti20_vwap_session": "vwap_session",
    "ti15_ichimoku": "conversion base lagging span_a span_b",
    "ti16_vortex": "vi_plus vi_minus",
    "ti17_keltner": "kc_middle kc_upper kc_lower",
    "ti19_volume_ratio": "volume_sma volume_ratio",
    "ti22_cmf": "cmf_20",
    "ti23_ti24_pivots_candles": "pivot r1 s1 position_in_range body upper_shadow lower_shadow",
    "ti26_latest_signals": "rsi sma_20 bb_position stoch_k",
    "ad13_contamination": "contamination",
    "fs3_training_set": "ret_scaled volume_scaled target",
    "rs1_rolling_statistics": "mean_5 std_5 var_5 min_5 max_5 sum_5 median_5 q25_5 q75_5 skew_5 kurt_5 mean_20 std_20 var_20 min_20 max_20 sum_20 median_20 q25_20 q75_20 skew_20 kurt_20",
    "rs2_z_score": "z_20",
    "rs3_percentile_rank": "rank_20",
    "rs4_entropy": "entropy_20",
    "rs5_correlation": "corr_20",
    "rs6_j7_beta": "market beta_20 beta_mixed",
    "rs7_rs10_volatility": "vol_20 parkinson_20",
    "rs9_vol_of_vol": "vol_of_vol",
    "rs11_momentum_family": "diff_5 pct_5 log_5 diff_10 pct_10 log_10",
    "rs12_mean_reversion": "ma_gap_20",
    "rs13_moments": "skew_20 kurt_20 m3_20 m4_20",
    "rs14_distribution": "mean std skew kurt iqr tail_range cv",
    "rs15_autocorrelation": "acf_1 acf_5",
    "rs16_ljung_box": "ljung_box",
    "rs17_lag_features": "lag_1 diff_1 pct_1 lag_2 diff_2 pct_2 lag_3 diff_3 pct_3",
    "rs18_returns": "ret log_ret cum_ret",
    "st1_st2_stream_bars": "open high low close",
    "st6_keyed_state": "ema obv",
    "st7_row_frames_on_stream": "sma_20",
    "st13_latest_trade": "price",
    "st5_stream_dedupe": "price",
    "snk3_stream_dead_letters": "price",
    "st8_layers": "high low",
    "st6_indicator_state": "rsi macd macd_signal macd_hist psar garch_vol",
    "ti27_sets": "close sma_20 ema_50 sma_200 rsi_14 macd macd_signal macd_hist stoch_k stoch_d bb_upper bb_middle bb_lower bb_width bb_position atr_14 obv vwap_cum ad_line cmf_20 kc_upper kc_lower psar adx",
    "dr5_drift_report": "ks ks_p wasserstein wasserstein_norm psi chi_square js_distance",
    "ml10_search": "width mean_f1 sd_f1",
    "rs20_preparation": "close ret log_ret mean_20 std_20 vol_20 z_20",
    "fs3_training_table": "volume_scaled spread_scaled target",
    "ml11_mask_effect": "sharpe_all volatility_all drawdown_all sharpe_kept volatility_kept drawdown_kept",
    "ml5_target_thresholds": "threshold precision recall",
    "ml5_metric_threshold": "threshold score",
    "ml9_backtest_summary": "mean_f1 std_f1 min_f1 max_f1 mean_precision mean_recall stability",
    "ml2_inverse": "f0 f1 f2 f3 f4 f5 f6 f7 f8 f9 f10 f11 f12 f13 f14 f15 f16 f17 f18 f19 f20 f21 f22 f23 f24 f25 f26 f27 f28 f29 f30 f31 f32 f33 f34 f35 f36 f37 f38 f39 f40 f41 f42 f43 f44 f45 f46 f47 f48 f49 f50 f51 f52 f53 f54 f55 f56 f57 f58 f59 f60 f61 f62 f63",
    "pr4_rebalance_shares": "weight target shares value cost",
    "st11_indicator_alerts": "value",
    "st11_portfolio_alerts": "value",
    "ad15_dynamic_selection": "dynamic_score",
    "ti18_psar": "psar",
    "ti18_psar_plain": "psar",
    "ti27_all_indicators": "open high low close vwap sma_5 sma_10 sma_20 sma_50 rsi_14 bb_upper bb_middle bb_lower bb_width bb_position stoch_k tr tp williams_r momentum_10 roc_10 cmf_20 volume_ratio vi_plus vi_minus position_in_range body upper_shadow lower_shadow pivot r1 s1 stoch_d atr_14 cci_20",
    "rs8_garch": "garch_vol",
    "rs19_feature_set": "open high low close vwap ret log_ret ret_mean_20 ret_std_20 ret_skew_20 ret_kurt_20 ret_q25_20 ret_q75_20 z_20 rank_20 vol_20 parkinson_20 ma_gap_20 diff_5 pct_5 log_5 diff_10 pct_10 log_10 entropy_20 skew_20 kurt_20 m3_20 m4_20 iqr_50 tail_range_50 acf_1 acf_5 ljung_box",
}
