"""Personal information in free text: a character BiLSTM-CRF in numpy."""
