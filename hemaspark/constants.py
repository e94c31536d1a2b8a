"""Names, prefixes, marks and polygons as the instruments' exports define them."""

# Fixed values.
#: Measures that decide whether repeated measurements agree.
CORE_MEASURES = [
    "WBC(10^3/uL)", "RBC(10^6/uL)", "HGB(g/dL)", "HCT(%)", "PLT(10^3/uL)",
]
#: Features that others are correlated with.
ANCHOR_FEATURES = [
    "PLT(10^3/uL)", "MPV(fL)", "PCT(%)", "RBC(10^6/uL)", "HGB(g/dL)", "HCT(%)", "MCV(fL)", "MCH(pg)", "MCHC(g/dL)", "RDW-SD(fL)", "WBC(10^3/uL)",
    "NEUT#(10^3/uL)", "LYMPH#(10^3/uL)", "MONO#(10^3/uL)", "EO#(10^3/uL)", "BASO#(10^3/uL)", "NEUT%(%)", "LYMPH%(%)", "MONO%(%)", "EO%(%)",
    "BASO%(%)",
]
#: Sample numbers of controls, calibrations and errors begin with one of these.
TECHNICAL_PREFIXES = [
    "QC-", "BACKGROUNDCHECK", "CAL-", "CAL", "xncal", "ERR", "PRE-CHK-", "OPT-AXIS",
]
#: Columns that are dropped, besides reserved and unnamed ones.
UNUSED_COLUMNS = [
    "Nickname", "Rack", "Position", "Sample Inf.", "Order Type", "Measurement Mode", "Discrete", "Patient ID", "Analysis Info.", "Judgment",
    "Order Info.", "WBC Info.", "PLT Info.", "Rule Result", "Validate", "Validator", "Action Message (Check)", "Action Message (Review)",
    "Action Message (Retest)", "Sample Comment", "Patient Name", "Birth", "Sex", "Patient Comment", "Ward Name", "Doctor Name", "Output",
    "Sequence No.", "Unclassified()",
]
#: Haemoglobin in other units.
REDUNDANT_HGB = [
    "HGB_NONSI(g/dL)", "HGB_SI(mmol/L)", "HGB_SI2(mmol/L)", "HGB_NONSI2(g/dL)", "HGB-S(g/dL)",
]
#: Data marks and their labels.
MARKS = {"----": "error", "++++": "oor", "*": "low_reliability", "@": "oor_linearity", "!": "oor_panic"}
#: Flags of clotted samples.
CLOT_INDICATORS = [
    "IP SUS(RBC)Turbidity/HGB Interf?", "IP SUS(RBC)RBC Agglutination?", "IP SUS(PLT)PLT Clumps?",
]
#: Columns that the WPC channel measures.
WPC_COLUMNS = [
    "WPC-X(ch)", "WPC-Y(ch)", "WPC-Z(ch)", "WPC-AREA1#()", "WPC-AREA2#()", "WPC-AREA3#()", "WPC_TOTAL_COUNT()", "WPC_PLOT_COUNT()",
]
#: Columns that the RET channel measures.
RET_COLUMNS = [
    "RET%(%)", "RET#(10^6/uL)", "IRF(%)", "MFR(%)", "LFR(%)", "RET-He(pg)", "RBC(10^6/uL)_He_pg", "HYPO-He(%)", "HYPER-He(%)", "Delta-He(pg)",
    "FRC%(%)", "FRC#(10^6/uL)", "RBC(10^6/uL)_O", "RBC(10^6/uL)_I", "HGB(g/dL)_O", "RPI()", "IRF-Y(ch)", "RBC(10^6/uL)_O_hsA", "RBC(10^6/uL)_I_hsA",
    "PLT(10^3/uL)_O",
]
#: Columns that the DIFF channel measures.
DIFF_COLUMNS = [
    "NEUT%(%)", "NEUT#(10^3/uL)", "LYMPH%(%)", "LYMPH#(10^3/uL)", "MONO%(%)", "MONO#(10^3/uL)", "EO%(%)", "EO#(10^3/uL)", "BASO%(%)",
    "BASO#(10^3/uL)", "IG%(%)", "IG#(10^3/uL)", "NEUT-RI(FI)", "NEUT-GI(SI)", "AS-LYMP%(%)", "AS-LYMP#(10^3/uL)", "RE-LYMP#(10^3/uL)",
    "NEUT#(10^3/uL)_minus_IG#(10^3/uL)", "NEUT%&(%)", "LYMPH#(10^3/uL)_minus_HFLC#(10^3/uL)", "LYMP%&(%)", "LYMPH#(10^3/uL)_hsA", "LYMPH%(hsA)(%)",
    "LY-X(ch)", "LY-Y(ch)", "LY-Z(ch)", "NEUT#(10^3/uL)_hsA", "NEUT#(10^3/uL)_hsA_MARK", "MONO%(hsA)(%)", "MONO#(10^3/uL)_hsA", "EO%(hsA)(%)",
    "EO#(10^3/uL)_hsA", "AS-LYMP%L(%)",
]
#: Columns that the CBC channel measures.
CBC_COLUMNS = [
    "WDF-WY()", "RBC(10^6/uL)", "HGB(g/dL)", "HCT(%)", "MCV(fL)", "MCH(pg)", "MCHC(g/dL)", "PLT(10^3/uL)", "RDW-SD(fL)", "RDW-CV(%)", "PDW(fL)",
    "MPV(fL)", "P-LCR(%)", "PCT(%)", "WBC(10^3/uL)_FX_ch", "DLT_WBC(10^3/uL)D", "WBC(10^3/uL)_N2", "WBC(10^3/uL)_D2", "WBC(10^3/uL)_P2",
    "HF%(hsA)(/100WBC)(10^3/uL)", "IP_ABN_WBC(10^3/uL)_Neutropenia", "IP_ABN_WBC(10^3/uL)_Neutrophilia", "IP_ABN_WBC(10^3/uL)_Abn_Lymphopenia",
    "IP_ABN_WBC(10^3/uL)_Abn_Lymphocytosis", "IP_SUS_WBC(10^3/uL)_Abn_Lympho_L_Blasts", "IP_SUS_WBC(10^3/uL)_Abn_Lympho", "WBC(10^3/uL)_N_SSC_FSC",
    "WBC(10^3/uL)_N_SSC_FSC_2", "WBC(10^3/uL)_hsA", "IP ABN(WBC(10^3/uL))NRBC(10^6/uL) Present", "IP ABN(RBC(10^6/uL))RBC(10^6/uL) Abn Distribution",
    "IP ABN(RBC(10^6/uL))Dimorphic Population", "IP ABN(RBC(10^6/uL))Anisocytosis", "IP ABN(RBC(10^6/uL))Microcytosis",
    "IP ABN(RBC(10^6/uL))Macrocytosis", "IP ABN(RBC(10^6/uL))Hypochromia", "IP ABN(RBC(10^6/uL))Anemia", "IP ABN(RBC(10^6/uL))Erythrocytosis",
    "IP ABN(RBC(10^6/uL))RET Abn Scattergram", "IP ABN(RBC(10^6/uL))Reticulocytosis", "IP SUS(RBC(10^6/uL))RBC(10^6/uL) Agglutination?",
    "IP SUS(RBC(10^6/uL))Turbidity/HGB(g/dL) Interf?", "IP SUS(RBC(10^6/uL))Iron Deficiency?", "IP SUS(RBC(10^6/uL))HGB(g/dL) Defect?",
    "IP SUS(RBC(10^6/uL))Fragments?", "Q-Flag(RBC(10^6/uL) Agglutination?)", "NRBC(10^6/uL)_COUNT", "NRBC(10^6/uL)_PERC_PERC", "MicroR(%)",
    "MacroR(%)", "RBC(10^6/uL)_O", "RBC(10^6/uL)_He_pg", "RET_RBC(10^6/uL)_Y_ch", "S-RBC(10^6/uL)(10^6/uL)", "RET_RBC(10^6/uL)_X_ch",
    "RET_RBC(10^6/uL)_Z_ch", "RET_RBC(10^6/uL)_WX", "RET_RBC(10^6/uL)_WY", "DLT-RBC()(10^6/uL)", "DLT_PLT(10^3/uL)O", "PLT(10^3/uL)_F_AREA1_COUNT",
    "PLT(10^3/uL)_F_RBC(10^6/uL)_X_ch", "PLT(10^3/uL)_F_RBC(10^6/uL)_Y_ch", "PLT(10^3/uL)_F_RBC(10^6/uL)_Z_ch", "PLT(10^3/uL)_F_RBC(10^6/uL)_WX",
    "PLT(10^3/uL)_F_RBC(10^6/uL)_WY", "TNC(10^3/uL)_N2", "TNC(10^3/uL)_D2", "TNC(10^3/uL)_P2", "NRBC(10^6/uL)_X_ch", "NRBC(10^6/uL)_Y_ch",
    "RBC(10^6/uL)_I", "IP_SUS-RBC(10^6/uL)(10^6/uL)_pRBC(10^6/uL)_R", "Q-Flag(pRBC?(R))(10^6/uL)_R", "PRBC(10^6/uL)_WNR_COUNT",
    "PRBC(10^6/uL)_WDF_COUNT", "IP_SUS-RBC(10^6/uL)(10^6/uL)_pRBC(10^6/uL)", "Q-Flag(pRBC?(R))(10^6/uL)", "RBC(10^6/uL)_BF_I", "RBC(10^6/uL)_hsA",
    "RBC(10^6/uL)_hsA_MARK", "RBC(10^6/uL)_I_hsA", "RBC(10^6/uL)_I_hsA_MARK", "RBC(10^6/uL)_O_hsA", "RBC(10^6/uL)_O_hsA_MARK",
    "Q-Flag(Turbidity/HGB(g/dL) Interf?)", "Q-Flag(HGB(g/dL) Defect?)", "HGB(g/dL)_BLANK", "HGB(g/dL)_SAMPLE", "HGB(g/dL)_NONSI",
    "HGB(g/dL)_SI_mmol_L", "HGB(g/dL)_SI2_mmol_L", "HGB(g/dL)_NONSI2", "HGB(g/dL)_O", "HGB(g/dL)_S", "HCT(%)", "S_MCV(fL)", "L_MCV(fL)", "MCV(fL)",
    "PLT(10^3/uL)_I", "PLT(10^3/uL)_F", "DLT_PLT(10^3/uL)O", "IP_SUS_PLT(10^3/uL)_Giant_PLT(10^3/uL)",
]
#: Tokens of the Discrete column that say which channel ran, and the channel's columns.
CHANNEL_COLUMNS = {"CBC": CBC_COLUMNS, "DIFF": DIFF_COLUMNS, "RET": RET_COLUMNS, "WPC": WPC_COLUMNS}
ALL_CHANNELS = "FREE SELECT"
#: Event channels: columns in order.
EVENT_COLUMNS = {
    "RET": ["SFL", "FSC"], "PLTF": ["SFL", "FSC", "SSC", "FSCW"], "WDF": ["SSC", "SFL", "FSC", "FSCW"], "WNR": ["SFL", "FSC", "SSC", "FSCW"],
    "WPC": ["SSC", "FSC", "SFL"], "RBC": [], "PLT": [],
}
#: Shares below which an event counts as rare, and weights below which a target component is passed over, by channel.
RARE_THRESHOLD = {"WDF": 0.005, "WNR": 0.01, "PLTF": 0.003, "RET": 0.01}
OMEGA_THRESHOLD = {"WDF": 0.03, "WNR": 0.05, "PLTF": 0.02, "RET": 0.05}
#: Axes of the default gates, and their polygons.
GATE_AXES = {"RET": ("SFL", "FSC"), "WDF": ("SSC", "SFL"), "WNR": ("SFL", "FSC"), "PLTF": ("SFL", "FSC")}
GATES = {
    "RET": {
        "RBC": [[-4.10896774193548, 16.925446428571433], [18.87322580645162, 52.16473214285715], [59.45116129032258, 54.42366071428572], [68.06948387096773, 259.9861607142857], [-2.3134838709677368, 260.8897321428571]],
        "RET": [[60.52845161290323, 74.30223214285714], [259.46806451612906, 122.19151785714286], [259.8271612903226, 259.9861607142857], [68.4285806451613, 259.9861607142857]],
        "PLT": [[-3.749870967741927, -4.308482142857137], [-4.10896774193548, 16.473660714285714], [19.232322580645167, 52.16473214285715], [59.45116129032258, 53.971875], [259.8271612903226, 115.41473214285713], [259.8271612903226, -5.212053571428562]],
    },
    "WDF": {
        "LYMPH": [[6.641548387096776, 26.41294642857143], [100.71070967741937, 47.19508928571429], [99.99535483870969, 260.4379464285714], [-4.088774193548389, 259.53437499999995]],
        "MONO": [[167.95406451612905, 259.0825892857143], [157.9390967741936, 137.55223214285712], [127.17883870967745, 63.911160714285714], [100.71070967741937, 47.19508928571429], [99.99535483870969, 259.9861607142857]],
        "IG": [[238.4165161290323, 258.63080357142854], [247.35845161290325, 91.4700892857143], [127.17883870967745, 63.459374999999994], [158.29677419354843, 136.196875], [168.3117419354839, 259.53437499999995]],
        "NEUTBASO": [[71.73883870967742, 25.057589285714286], [110.72567741935487, 15.570089285714289], [160.08516129032262, 30.479017857142864], [189.05703225806454, 54.875446428571436], [219.45961290322583, 59.393303571428575], [218.02890322580652, 84.24151785714287], [127.89419354838714, 63.00758928571429], [101.06838709677422, 46.291517857142864], [41.69393548387098, 33.64151785714286]],
        "EO": [[226.61316129032264, 27.768303571428575], [189.05703225806454, 21.443303571428572], [172.9615483870968, 20.991517857142867], [159.72748387096777, 30.479017857142864], [189.05703225806454, 54.875446428571436], [219.101935483871, 59.393303571428575], [250.93522580645168, 60.74866071428572], [258.4464516129033, 25.057589285714286]],
    },
    "WNR": {
        "WBC": [[108.64741935483869, 131.30133928571433], [104.33825806451611, 99.02991071428575], [124.44767741935482, 43.00312500000001], [181.54406451612903, 57.79419642857144], [259.1089677419355, 61.37991071428573], [258.7498709677419, 154.60848214285716]],
        "BASO": [[109.00651612903224, 130.85312500000003], [258.7498709677419, 154.1602678571429], [260.90445161290324, 257.69776785714294], [153.53451612903226, 258.1459821428572]],
        "NRBC": [[55.860193548387095, 257.24955357142863], [63.40122580645161, 120.99241071428573], [109.36561290322581, 129.95669642857143], [153.8936129032258, 257.24955357142863]],
    },
    "PLTF": {
        "RBC": [[-2.3134838709677368, 259.1625], [-3.3907741935483813, 174.45535714285717], [148.8662580645161, 175.71964285714287], [148.8662580645161, 260.84821428571433]],
        "WBC": [[261.62264516129034, 259.1625], [149.58445161290322, 260.84821428571433], [148.8662580645161, 175.71964285714287], [168.61658064516126, 189.20535714285717], [218.17193548387095, 176.98392857142858], [210.98999999999998, 151.27678571428572], [261.62264516129034, 149.59107142857144]],
        "PLT": [[33.955290322580645, 13.469642857142862], [35.032580645161296, 58.562500000000014], [126.60225806451612, 145.7982142857143], [128.39774193548385, 14.312500000000004]],
        "immaturePLT": [[199.49890322580646, 58.562500000000014], [210.6309032258064, 151.27678571428572], [218.89012903225805, 176.5625], [168.9756774193548, 189.20535714285717], [148.8662580645161, 175.71964285714287], [126.60225806451612, 146.21964285714287], [128.39774193548385, 29.062500000000004]],
    },
}
