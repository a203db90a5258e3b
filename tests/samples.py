"""Sample tables with planted faults, as delimited text."""

USERS_CSV = '''id,name,email,age,join_date,status,score,metadata
1,Ottilie Brandt,ottilie@mail.test,61,2023-03-02,pending,12.25,"{""lang"": ""de""}"
2,Rahul Sen,,19,2023-03-05,active,70.0,"{""lang"": ""en"", ""beta"": true}"
3,Ines Prado,ines@mail.test,N/A,2023-03-09,active,33.5,""
4,Tomas Lind,tomas@mail.test,47,2023-04-01,inactive,58.75,"{""lang"": ""sv"", ""size"": "
5,Mara Okafor,mara@post,38,2023-04-11,suspended,91.0,"{""lang"": ""ig"", ""tags"": [1, 2]}"
6,Jun Sato,jun@mail.test,24,2023-05-20,active,44.1,"{""lang"": ""ja"", ""size"": 3}"
7,Lea Fournier,lea@mail.test,52,2023-06-30,pending,87.9,""
8,Piotr Zajac,piotr@mail.test,33,2023-07-07,active,5.5,"{""beta"": false}"
'''

ORDERS_CSV = '''order_id,customer_id,order_date,total_amount,shipping_address,item_count
1,501,2023-09-01,INVALID,"12 Quay Road, Port Alder",4
2,502,2023-09-02,75.10,"8 Mill Lane, Dunmore",
3,503,someday,18.00,"77 Hill Street, Ashby",2
4,504,2023-09-04,-5.25,"3 Field Close, Wick",1
5,505,2023-09-05,0.00,"41 Tower Row, Selby",6
6,506,2023-09-06,640.00,,3
7,507,2023-09-07,22.22,"9 Beech Walk, Corran",2
8,508,2023-09-08,310.40,,5
9,509,2023-09-09,58.60,"16 Ferry Way, Oban",1
'''

TRANSACTIONS_CSV = '''transaction_id,customer_id,amount,date,category,status
1,71,9.99,2023-02-01,books,completed
2,72,INVALID,2023-02-02,garden,pending
3,73,120.00,2023-02-03,,completed
4,74,-8.50,2023-02-04,books,cancelled
5,75,0.00,2023-02-05,travel,completed
6,76,33.30,no-date-given,garden,completed
7,77,410.00,2023-02-07,travel,unheard_of
8,78,15.75,2023-02-08,,pending
'''

ROWS = {"users": 8, "orders": 9, "transactions": 8}
