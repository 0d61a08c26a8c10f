"""Logs of each format with their canonical forms, and the one published pair of a log and its fingerprint."""

# Fixed value: a log and the SHA-256 of its canonical form.
SSHD = "<34>Aug 30 13:02:11 auth-server sshd[12345]: Accepted publickey for user admin from 10.0.0.5 port 52341 ssh2: RSA SHA256:abc1234567890abcdef1234567890abcdef1234567890abcdef1234567890abcdef"
SSHD_FINGERPRINT = "48ab70570eacc9bc4a113257af310c57cb882da6b372b6c15e4cb05f9f6246da"

CANONICAL = [
    (
        '{"when":"2031-02-03T04:05:06Z","peer":"172.16.9.9","ok":true,"size":77,"who":{"id":5,"mail":"zoe@shop.test"},"list":["x","y"]}',
        "fp-v1:format=json|schema=object{list:array[string],ok:bool,peer:ipv4,size:number,when:timestamp,who:object{id:number,mail:email}}",
    ),
    (
        'unit=pump7 at=04:05:06 state="open" level=3 peer=172.16.9.9 key=7c9e6679-7425-40de-944b-e07fc1f90ae7 note="two words"',
        "fp-v1:format=key_value|fields=at:time,key:uuid,level:number,note:string,peer:ipv4,state:string,unit:string",
    ),
    ("<13>Feb  3 04:05:06 mill grinder[77]: wheel 12 stopped after 340 s", "fp-v1:format=syslog|ver=0|fac=1|sev=5|app=grinder|msg_id=|template=wheel <NUMBER> stopped after <NUMBER> s"),
    (
        '<46>1 2031-02-03T04:05:06.250Z mill.example grinder 77 WHL [env@9 zone="b" line="2"] wheel 12 stopped',
        "fp-v1:format=syslog|ver=1|fac=5|sev=6|app=grinder|msg_id=WHL|sd=env@9.line,env@9.zone|template=wheel <NUMBER> stopped",
    ),
    (
        "CEF:0|Orchard|Gate|2.1|701|Door open|3|src=172.16.9.9 cnt=4 fname=a b",
        "fp-v1:format=cef|vendor=orchard|product=gate|ver=0|dev_vendor=Orchard|dev_product=Gate|dev_ver=2.1|class_id=701|sev=3|ext=cnt:number,fname:string,src:ipv4",
    ),
    (
        "LEEF:1.0|Orchard|Gate|2.1|701|src=172.16.9.9\tcnt=4",
        "fp-v1:format=leef|vendor=orchard|product=gate|ver=1.0|vendor=Orchard|product=Gate|prod_ver=2.1|event_id=701|delim=\t|ext=cnt:number,src:ipv4",
    ),
    ('<Reading unit="7"><Value>12</Value><Peer>172.16.9.9</Peer></Reading>', "fp-v1:format=xml|hierarchy=Reading[unit];Reading/Peer;Reading/Value;"),
    (
        "java.lang.ArithmeticException: wheel 12\n\tat org.mill.Wheel.turn(Wheel.java:31)\nCaused by: java.io.EOFException: end",
        "fp-v1:format=multiline|stack=true|prefix=java_stack|lines=java.lang.ArithmeticException: wheel <NUMBER>||at org.mill.Wheel.turn||Caused by: java.io.EOFException: end",
    ),
    ("wheel 12 of 172.16.9.9:8080 stopped at 2031-02-03 04:05:06", "fp-v1:format=plain_text|template=wheel <NUMBER> of <IPV4>:<PORT> stopped at <TIMESTAMP>"),
    ("", "fp-v1:format=unknown"),
]

MALFORMED = [" \t ", "[", '{"k":', "<a><b></a>", "><", "CEF:0|x", "LEEF:1.0", "<1000>x", "=,=", ";;;", "\x07\ufffd", "\0" * 70_000, "[" * 300 + "]" * 300, "04:05:06 x"]
