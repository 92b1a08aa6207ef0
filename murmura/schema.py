"""Names of measures and keys."""

from __future__ import annotations

#: Measures by descending variance, as the ranking of measures has them.
RANKED = """
LdgToFcAmp HiFtoUpprKnAmp HiFtoKnAmp HiFtoFcAmp UpprKnToKnAmp KnToFcAmp Amp4thQrtl Amp2ndQrtl Amp3rdQrtl PrecedingIntrvl
PrcntKneeDur Amp1stQrtl PrcntMaxAmpDur AmpK@start FFwd32dB Bndw32dB StartF HiFreq UpprKnFreq FFwd20dB FreqKnee FFwd15dB
Bndwdth FFwd5dB FreqMaxPwr FreqCtr FBak5dB FreqLedge AmpK@end Fc FBak15dB FBak32dB EndF FBak20dB LowFreq Bndw20dB
CallsPerSec EndSlope SteepestSlope StartSlope Bndw15dB HiFtoUpprKnSlp HiFtoKnSlope DominantSlope Bndw5dB PreFc500
PreFc1000 PreFc3000 KneeToFcSlope TotalSlope PreFc250 CallDuration CummNmlzdSlp DurOf32dB SlopeAtFc LdgToFcSlp DurOf20dB
DurOf15dB TimeFromMaxToFc KnToFcDur HiFtoFcExpAmp AmpKurtosis LowestSlope KnToFcDmp HiFtoKnExpAmp DurOf5dB KnToFcExpAmp
RelPwr3rdTo1st LnExpB_StartAmp HiFtoKnDmp LnExpB_EndAmp HiFtoFcDmp AmpSkew LedgeDuration KneeToFcResidue
PreFc3000Residue AmpGausR2 PreFc1000Residue Amp1stMean LdgToFcExp FcMinusEndF Amp4thMean HiFtoUpprKnExp HiFtoKnExp
KnToFcExp UpprKnToKnExp Kn-FcCurviness Quality Amp2ndMean HiFtoFcExp LnExpA_EndAmp RelPwr2ndTo1st LnExpA_StartAmp
HiFminusStartF Amp3rdMean PreFc500Residue Kn-FcCurvinessTrndSlp PreFc250Residue AmpVariance AmpMoment meanKn-FcCurviness
MinAccpQuality Max#CallsConsidered AmpStartLn60ExpC AmpEndLn60ExpC
""".split()

#: Families of measures; a measure may be in several and even twice in one.
FAMILIES = {
    "exp_fit": "HiFtoFcAmp HiFtoFcDmp KnToFcAmp KnToFcDmp HiFtoKnExpAmp HiFtoKnDmp HiFtoUpprKnAmp HiFtoUpprKnExp HiFtoKnAmp HiFtoKnExp HiFtoFcExp UpprKnToKnAmp UpprKnToKnExp KnToFcExp LdgToFcAmp LdgToFcExp LnExpA_StartAmp LnExpB_StartAmp AmpStartLn60ExpC LnExpA_EndAmp LnExpB_EndAmp AmpEndLn60ExpC PreFc250Residue PreFc500Residue PreFc1000Residue PreFc3000Residue KneeToFcResidue HiFtoFcExpAmp KnToFcExpAmp AmpStartLn60ExpC".split(),
    "amplitudes": "PrcntMaxAmpDur Amp1stQrtl Amp2ndQrtl Amp3rdQrtl Amp4thQrtl Amp1stMean Amp2ndMean Amp3rdMean Amp4thMean AmpVariance AmpMoment AmpGausR2".split(),
    "frequencies": "FreqMaxPwr FreqCtr FFwd32dB FBak32dB FFwd20dB FBak20dB FFwd15dB FBak15dB FFwd5dB FBak5dB PreFc250 PreFc500 PreFc1000 PreFc3000 StartF HiFreq UpprKnFreq FreqKnee FreqLedge Fc EndF LowFreq RelPwr2ndTo1st RelPwr3rdTo1st HiFminusStartF".split(),
    "bandwidths": "Bndwdth Bndw32dB Bndw20dB Bndw15dB Bndw5dB FcMinusEndF".split(),
    "durations": "TimeFromMaxToFc DurOf32dB DurOf20dB DurOf15dB DurOf5dB PrcntMaxAmpDur PrecedingIntrvl PrcntKneeDur CallsPerSec CallDuration KnToFcDur".split(),
    "slopes": "AmpK@start AmpK@end AmpKurtosis AmpSkew EndSlope SteepestSlope StartSlope HiFtoUpprKnSlp HiFtoKnSlope DominantSlope KneeToFcSlope TotalSlope CummNmlzdSlp SlopeAtFc LdgToFcSlp LowestSlope Kn-FcCurvinessTrndSlp".split(),
    "knee_ledges": "LedgeDuration LedgeDuration Kn-FcCurviness Kn-FcCurvinessTrndSlp meanKn-FcCurviness KnToFcAmp KnToFcDmp HiFtoKnExpAmp UpprKnToKnAmp UpprKnToKnExp KnToFcExp LdgToFcAmp LdgToFcExp KneeToFcResidue KnToFcExpAmp UpprKnFreq FreqKnee FreqLedge PrcntKneeDur KnToFcDur HiFtoUpprKnSlp HiFtoKnSlope KneeToFcSlope".split(),
    "quality": "Quality MinAccpQuality Max#CallsConsidered".split(),
}

#: What the forecasters predict, and the key columns beside it.
PREDICTED = "TimeInFile PrecedingIntrvl HiFreq Bndwdth FreqMaxPwr PrcntMaxAmpDur FreqKnee PrcntKneeDur StartF FreqCtr FFwd32dB FFwd20dB FFwd15dB FBak5dB FFwd5dB Bndw32dB Amp1stQrtl Amp2ndQrtl Amp3rdQrtl Amp4thQrtl AmpK@start UpprKnFreq HiFtoUpprKnAmp HiFtoKnAmp HiFtoFcAmp UpprKnToKnAmp KnToFcAmp LdgToFcAmp".split()
PREDICTION_KEYS = ["file_id", "cntxt_sz", "model_id", "chirp_idx"]

#: Columns that describe the export, not the call.
ADMINISTRATIVE = ["Filename", "Path", "ParentDir", "NextDirUp", "Version", "Filter", "Preemphasis", "MaxSegLngth", "MaxSegLnght"]

#: The key of a call: its recording, and its 0-based place there.
KEY = ("file_id", "chirp_idx")
